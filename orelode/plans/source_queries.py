"""Queries on the structure of sources, chunks, patches and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions import paths, text
from orelode.operators import chunks, pysource
from orelode.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def python_rows(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "files").where(paths.language(F.col("path")) == "python").select("file_id", "content")
    return pysource.read_python(f, {"file_id": "bigint"})


def scripts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").where(paths.language(F.col("path")).isin("javascript", "typescript")).select("file_id", "content").where("content is not null")


_JS = "regexp_matches(lower(path), '\\.(js|jsx|ts|tsx)$') AND content IS NOT NULL"


def _kind(name: str, *kinds: str):
    def run(spark, root):
        return python_rows(spark, root).where(F.col("kind").isin(*kinds)).drop("kind")

    QUERIES[name] = run


for _name, _kinds in {
    "s283_python_imports": ("import",), "s283_python_functions": ("function", "method"), "s283_python_classes": ("class",), "s283_python_routes": ("route",), "s283_syntax_errors": ("error",),
    "s283_structure": ("import", "function", "method", "class", "route"), "s281_ast_rules": ("rule",), "s282_flows": ("flow",),
}.items():
    _kind(_name, *_kinds)
# A text that breaks each rule, the line it breaks it on, and a near miss. They stand beside the files, with p_size empty lines before them.
_IN = "from flask import request\nimport os, subprocess, requests, pickle, yaml, jwt\n"
CASES = {
    "subprocess_shell_true": (_IN + "subprocess.run(cmd, shell=True)", 3, _IN + "subprocess.run(cmd)"),
    "tls_verification_disabled": (_IN + "requests.get(u, verify=False)", 3, _IN + "requests.get(u, verify=True)"),
    "unsafe_deserialization": (_IN + "yaml.load(x)", 3, _IN + "yaml.load(x, Loader=yaml.SafeLoader)"),
    "jwt_signature_verification_disabled": (_IN + "jwt.decode(t, options={'verify_signature': False})", 3, _IN + "jwt.decode(t, k)"),
    "jwt_algorithm_verification_bypass": (_IN + "jwt.decode(t, k, algorithms=['none'])", 3, _IN + "jwt.decode(t, k, algorithms=['HS256'])"),
    "jwt_insecure_secret_fallback": (_IN + "K = os.getenv('JWT_SECRET', 'dev')", 3, _IN + "K = os.getenv('JWT_SECRET')"),
    "insecure_auth_cookie": (_IN + "resp.set_cookie('session', v, httponly=False)", 3, _IN + "resp.set_cookie('theme', v, httponly=False)"),
    "permissive_cors": (_IN + "app.add_middleware(C, allow_origins=['*'], allow_credentials=True)", 3, _IN + "app.add_middleware(C, allow_origins=['*'])"),
    "os_system_call": (_IN + "def f():\n    c = request.args.get('c')\n    os.system('ls ' + c)", 5, _IN + "os.system('ls')"),
    "path_traversal_file": (_IN + "def f():\n    p = request.args['p']\n    return open(p)", 5, _IN + "open('a')"),
    "ssrf_untrusted_url": (_IN + "def f():\n    u = request.json['u']\n    requests.get(u)", 5, _IN + "def f():\n    u = validate_url(request.json['u'])\n    requests.get(u)"),
    "sql_injection": (_IN + "def q(x):\n    return f'select {x}'\ndef f(cur):\n    cur.execute(q(request.form['x']))", 6, _IN + "def f(cur):\n    cur.execute('select ?', request.form['x'])"),
    "command_injection": (_IN + "def f():\n    if a:\n        c = request.form.get('c')\n    subprocess.run(c, shell=True)", 6, _IN + "def f():\n    c = request.form.get('c')\n    c = 'ls'\n    subprocess.run(c, shell=True)"),
    "ssrf": (_IN + "for u in request.json['urls']:\n    requests.post(u)", 4, _IN + "requests.post('https://a')"),
    "xss_unsafe_html_sink": (_IN + "def f():\n    return Markup('<b>' + request.query_params['q'])", 4, _IN + "Markup('<b>')"),
}


def _rule(rule: str):
    yes, line, no = CASES[rule]

    def run(spark, root):
        body = F.concat(F.repeat(F.lit("\n"), F.col("p_size")), F.when(F.col("p_partkey") % 2 == 0, yes).otherwise(no), F.lit("\n"))
        cases = table(spark, root, "part").select((-1 - F.col("p_partkey")).alias("file_id"), body.alias("content"))
        f = table(spark, root, "files").where(paths.language(F.col("path")) == "python").select("file_id", "content").unionByName(cases)
        found = pysource.read_python(f, {"file_id": "bigint"}).where(F.col("kind").isin("rule", "flow") & (F.col("name") == rule))
        return found.select("file_id", F.col("name").alias("rule"), "line", "severity")

    QUERIES[f"s281_py_{rule}"] = run
    # none of the given files breaks these rules; the cases must be found on their line, the near misses not
    ORACLES[f"s281_py_{rule}"] = f"SELECT -1 - p_partkey AS file_id, '{rule}' AS rule, p_size + {line} AS line, '{pysource.SEVERITY[rule]}' AS severity FROM part WHERE p_partkey % 2 = 0"


for _name in CASES:
    _rule(_name)


IMPORT, REQUIRE = r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]""", r"""require\(['"]([^'"]+)['"]\)"""
FUNCTION = r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"
CLASS, ROUTE = r"\bclass\s+([A-Za-z_$][\w$]*)\b", r"""\b(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*['"]([^'"]+)['"]"""
_q = lambda x: "'" + x.replace("'", "''") + "'"


@query(f"SELECT file_id, array_to_string(list_distinct(list_concat(regexp_extract_all(content, {_q(IMPORT)}, 1), regexp_extract_all(content, {_q(REQUIRE)}, 1)).list_sort()).list_sort(), ',') AS modules FROM files WHERE {_JS}")
def s283_script_imports(spark, root):
    found = F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1)), F.regexp_extract_all("content", F.lit(REQUIRE), F.lit(1))))
    return scripts(spark, root).select("file_id", F.array_join(F.array_sort(found), ",").alias("modules"))


@query(f"SELECT file_id, array_to_string(list_sort(list_distinct(list_transform(generate_series(1, len(regexp_extract_all(content, {_q(FUNCTION)}, 1))), lambda i: coalesce(nullif(regexp_extract_all(content, {_q(FUNCTION)}, 1)[i], ''), regexp_extract_all(content, {_q(FUNCTION)}, 2)[i])))), ',') AS functions FROM files WHERE {_JS}")
def s283_script_functions(spark, root):
    one, two = (F.regexp_extract_all("content", F.lit(FUNCTION), F.lit(k)) for k in (1, 2))
    return scripts(spark, root).select("file_id", F.array_join(F.array_sort(F.array_distinct(F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b)))), ",").alias("functions"))


@query(f"SELECT file_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, {_q(CLASS)}, 1))), ',') AS classes FROM files WHERE {_JS}")
def s283_script_classes(spark, root):
    return scripts(spark, root).select("file_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(CLASS), F.lit(1)))), ",").alias("classes"))


@query(f"SELECT file_id, upper(m) AS method, p AS route FROM (SELECT file_id, unnest(regexp_extract_all(content, {_q(ROUTE)}, 1)) AS m, unnest(regexp_extract_all(content, {_q(ROUTE)}, 2)) AS p FROM files WHERE {_JS})")
def s283_script_routes(spark, root):
    one, two = (F.regexp_extract_all("content", F.lit(ROUTE), F.lit(k)) for k in (1, 2))
    return scripts(spark, root).select("file_id", F.explode(F.arrays_zip(one.alias("m"), two.alias("p"))).alias("z")).select("file_id", F.upper("z.m").alias("method"), F.col("z.p").alias("route"))


@query("SELECT DISTINCT f.file_id, f.line, arg_min(s.name, (s.end_line - s.start_line, s.start_line, s.name)) AS symbol FROM (SELECT DISTINCT fi.file_id, i.line FROM issues i JOIN files fi ON fi.project_id = i.project_id AND fi.path = i.file WHERE i.line > 0) f JOIN symbols s ON s.file_id = f.file_id AND f.line BETWEEN s.start_line AND s.end_line WHERE s.name IS NOT NULL GROUP BY f.file_id, f.line")
def s283_enclosing_symbol(spark, root):
    f = table(spark, root, "files").select("file_id", "project_id", F.col("path").alias("file"))
    places = table(spark, root, "issues").where("line > 0").select("project_id", "file", "line").join(f, ["project_id", "file"]).select("file_id", "line").distinct()
    return chunks.enclosing(table(spark, root, "symbols").where("name is not null"), places)


@query("SELECT file_id, name, start_line, md5(array_to_string(list_slice(string_split(content, chr(10)), start_line, end_line), chr(10))) AS body_md5 FROM (SELECT DISTINCT file_id, name, start_line, end_line FROM symbols WHERE end_line >= start_line AND start_line > 0) JOIN files USING (file_id) WHERE content IS NOT NULL")
def s283_line_slice(spark, root):
    s = table(spark, root, "symbols").where("end_line >= start_line and start_line > 0").select("file_id", "name", "start_line", "end_line").distinct()
    return s.join(table(spark, root, "files").select("file_id", "content").where("content is not null"), "file_id").select("file_id", "name", "start_line", F.md5(F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")).alias("body_md5"))


@query("SELECT * FROM (VALUES ('python', 'ast'), ('javascript', 'pattern'), ('typescript', 'pattern'), ('java', NULL), ('cpp', NULL)) t(language, analyzer)")
def s283_registry(spark, root):
    return spark.createDataFrame([("python", "ast"), ("javascript", "pattern"), ("typescript", "pattern"), ("java", None), ("cpp", None)], "language string, analyzer string")


def _lengths(spark, root):
    return table(spark, root, "files").where("content <> ''").select("file_id", F.size(F.split("content", "\n")).alias("lines"))


@query()
def s210_symbol_chunks(spark, root):
    return chunks.spans(chunks.cover(table(spark, root, "symbols")), _lengths(spark, root))


@query("SELECT file_id, len(string_split(content, chr(10)))::BIGINT AS covered FROM files WHERE content <> ''")
def s210_chunks_cover_all(spark, root):
    """Lines held by the chunks of each file: each line of each file exactly once."""
    return s210_symbol_chunks(spark, root).groupBy("file_id").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("covered"))


@query()
def s210_line_packs(spark, root):
    f = table(spark, root, "files").where("content <> ''").select("file_id", F.split("content", "\n").alias("ls"))
    return f.select("file_id", F.posexplode(chunks.packs(F.col("ls"))).alias("pack", "p")).where(F.col("pack") < chunks.PER_FILE).select("file_id", "pack", F.col("p.first").alias("first_line"), F.col("p.last").alias("last_line"))


@query("SELECT s.file_id, s.name, s.start_line, '# FILE: ' || f.path || chr(10) || '# LINES: ' || s.start_line || '-' || s.end_line || chr(10) || '# SYMBOL: ' || s.name || chr(10) AS header FROM (SELECT DISTINCT file_id, name, start_line, end_line FROM symbols WHERE end_line >= start_line AND name IS NOT NULL) s JOIN files f USING (file_id)")
def s210_headers(spark, root):
    s = table(spark, root, "symbols").where("end_line >= start_line and name is not null").select("file_id", "name", "start_line", "end_line").distinct()
    return s.join(table(spark, root, "files").select("file_id", "path"), "file_id").select("file_id", "name", "start_line", chunks.header(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name")).alias("header"))


@query("SELECT project_id, file_id FROM (SELECT project_id, file_id, file_ord FROM files WHERE content <> '') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY file_ord, file_id) <= 48")
def s25_call_budget(spark, root):
    from orelode.operators.retrieval import top
    return top(table(spark, root, "files").where("content <> ''").select("project_id", "file_id", "file_ord"), ["project_id"], ["file_ord", "file_id"], chunks.CALLS).select("project_id", "file_id")


QUERIES["s212_call_budget"] = s25_call_budget
ORACLES["s212_call_budget"] = ORACLES["s25_call_budget"]

# Patches: in every file the first "return" line gets a remark.
_FIRST = "regexp_extract(content, '(?:^|\\n)[ \\t]*return [^\\n]{3,}')"


def _patches(spark, root):
    f = table(spark, root, "files").where("content <> ''").select("file_id", "content")
    original = F.regexp_extract("content", r"(?:^|\n)[ \t]*return [^\n]{3,}", 0)
    return f.withColumn("original", original).withColumn("fixed", F.concat("original", F.lit(" # seen"))).withColumn("expected", F.when(F.col("file_id") % 5 == 0, F.lit("stale")).otherwise(F.sha2("content", 256)))


_PLACE = "CASE WHEN original = '' OR instr(content, original) = 0 THEN 0 WHEN instr(substr(content, instr(content, original) + 1), original) > 0 THEN -1 ELSE instr(content, original) END"
_PATCH = f"WITH p AS (SELECT file_id, content, {_FIRST} AS original, CASE WHEN file_id % 5 = 0 THEN 'stale' ELSE sha256(content) END AS expected FROM files WHERE content <> ''), q AS (SELECT *, {_PLACE} AS place FROM p)"


@query(_PATCH + "SELECT file_id, CASE WHEN original = '' THEN 'malformed_fix' WHEN expected <> sha256(content) THEN 'stale_source' WHEN place = 0 THEN 'target_not_found' WHEN place < 0 THEN 'ambiguous_target' ELSE 'ok' END AS status FROM q")
def s210_patch_status(spark, root):
    return _patches(spark, root).select("file_id", text.patch_status(F.col("content"), F.col("original"), F.col("fixed"), F.col("expected")).alias("status"))


@query(_PATCH + "SELECT file_id, length(content) - length(replace(content, chr(10), '')) - (length(substr(content, place)) - length(replace(substr(content, place), chr(10), ''))) + 1 AS start_line FROM q WHERE place > 0")
def s27_span_lines(spark, root):
    p = _patches(spark, root).withColumn("place", text.patch_place(F.col("content"), F.col("original"))).where("place > 0 and original <> ''")
    return p.select("file_id", text.line_of(F.col("content"), F.col("place") - 1).cast("bigint").alias("start_line"))


@query(_PATCH + "SELECT file_id, place::INT AS place FROM q WHERE original <> ''")
def s27_unique_find(spark, root):
    return _patches(spark, root).where("original <> ''").select("file_id", text.patch_place(F.col("content"), F.col("original")).cast("int").alias("place"))


@query()
def s27_unified_diff(spark, root):
    """The difference text of each patch that applies; its two sides are checked by the tests."""
    from orelode.operators.diffs import unified
    p = _patches(spark, root).where("original <> ''").select("file_id", "content", text.patched(F.col("content"), F.col("original"), F.col("fixed")).alias("patched"))
    return unified(p.where("patched is not null"), "file_id", "content", "patched")


_FIXED = "CASE WHEN contains(content, chr(13) || chr(10)) AND contains(original, chr(10)) THEN replace(replace(original || ' # seen', chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) ELSE original || ' # seen' END"


@query(_PATCH + f"SELECT file_id, md5(left(content, place - 1) || {_FIXED} || substr(content, place + length(original))) AS patched_md5 FROM q WHERE place > 0")
def s210_patch_apply(spark, root):
    p = _patches(spark, root).where("original <> ''")
    return p.select("file_id", F.md5(text.patched(F.col("content"), F.col("original"), F.col("fixed"))).alias("patched_md5")).where("patched_md5 is not null")


@query(_PATCH + f"SELECT file_id, md5({_FIXED}) AS fixed_md5 FROM q WHERE original <> ''")
def s27_crlf_kept(spark, root):
    return _patches(spark, root).where("original <> ''").select("file_id", F.md5(text.with_line_ends_of(F.col("content"), F.col("fixed"))).alias("fixed_md5"))


@query(_PATCH + "SELECT file_id, original <> '' AS has_target, place > 0 AS unique_target, expected = sha256(content) AS fresh FROM q")
def s210_validation_map(spark, root):
    p = _patches(spark, root).withColumn("place", text.patch_place(F.col("content"), F.col("original")))
    m = F.create_map(F.lit("has_target"), F.col("original") != "", F.lit("unique_target"), (F.col("original") != "") & (F.col("place") > 0), F.lit("fresh"), F.col("expected") == F.sha2("content", 256))
    return p.select("file_id", m.alias("m")).select("file_id", *[F.col("m")[k].alias(k) for k in ("has_target", "unique_target", "fresh")])


@query("SELECT file_id, md5(replace(content, 'random.choice(', 'secrets.choice(')) AS fixed_md5 FROM files WHERE content IS NOT NULL AND lower(path) LIKE '%.py'")
def s210_safe_random(spark, root):
    return table(spark, root, "files").where("content is not null and lower(path) like '%.py'").select("file_id", F.md5(F.regexp_replace("content", r"random\.choice\(", "secrets.choice(")).alias("fixed_md5"))


_TOK = "list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][a-zA-Z0-9_]{2,}'), lambda x: lower(x)))"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_CUT = "list_transform({0}, lambda x: CASE WHEN length(x) > 4 AND ends_with(x, 's') THEN left(x, length(x) - 1) ELSE x END)"
_OUT = "list_filter({0}, lambda x: NOT list_contains(" + _STOP + ", x))"


@query(f"SELECT doc_id, len({_TOK})::INT AS plain, len({_OUT.format(_TOK)})::INT AS question, len({_OUT.format('list_distinct(' + _CUT.format(_TOK) + ')')})::INT AS cut_then_stop, len(list_distinct({_CUT.format(_OUT.format(_TOK))}))::INT AS stop_then_cut FROM documents")
def s27_tokenisers(spark, root):
    t = F.col("text")
    return table(spark, root, "documents").select("doc_id", F.size(text.tokens(t)).alias("plain"), F.size(text.question_tokens(t)).alias("question"), F.size(text.singular_tokens(t)).alias("cut_then_stop"), F.size(text.singular_tokens(t, stop_first=True)).alias("stop_then_cut"))


@query("SELECT doc_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][a-zA-Z0-9_]{2,}'), lambda w: length(w) >= 5 AND (contains(w, '_') OR regexp_matches(w, '[a-z][A-Z]'))), lambda x: lower(x))))::INT AS names FROM documents")
def s27_identifiers(spark, root):
    return table(spark, root, "documents").select("doc_id", F.size(text.identifiers(F.col("text"))).alias("names"))


@query("SELECT doc_id, md5(lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))) AS squeezed_md5 FROM documents")
def s27_squeezed(spark, root):
    return table(spark, root, "documents").select("doc_id", F.md5(text.squeezed(F.col("text"))).alias("squeezed_md5"))


@query("SELECT doc_id, md5(left(regexp_replace(text, '(?i)(password|secret|token|api[_-]?key)\\s*[=:]\\s*[''\"][^''\"]+[''\"]', '\\1 = \"[REDACTED]\"', 'g'), 1200)) AS redacted_md5 FROM documents WHERE text IS NOT NULL")
def s27_redaction(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.md5(text.redacted(F.col("text"))).alias("redacted_md5"))


@query("SELECT file_id, lower(trim(path)) AS mail, regexp_replace(regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file_name FROM files")
def s27_file_names(spark, root):
    return table(spark, root, "files").select("file_id", text.mail(F.col("path")).alias("mail"), text.file_name(F.col("path")).alias("file_name"))


@query()
def s27_syntax_language(spark, root):
    return table(spark, root, "files").where("content is not null").select("file_id", text.syntax_language(F.col("content")).alias("by_syntax"))


@query("SELECT event_id, (props ->> 'k')::INT AS k FROM (SELECT event_id, props::JSON AS props FROM events)")
def s27_json(spark, root):
    wrapped = F.concat(F.lit("said: "), "props", F.lit(" done"))
    return table(spark, root, "events").select("event_id", F.try_variant_get(text.json_or_block(wrapped), "$.k", "int").alias("k"))


@query("SELECT issue_id, ingested_at, least(100, greatest(0, 100 - coalesce(line, 0))) AS clamped, floor(coalesce(line, 0) / 3)::BIGINT AS bucket FROM issues")
def s27_math(spark, root):
    return table(spark, root, "issues").select("issue_id", "ingested_at", F.least(F.lit(100), F.greatest(F.lit(0), 100 - F.coalesce("line", F.lit(0)))).alias("clamped"), F.floor(F.coalesce("line", F.lit(0)) / 3).alias("bucket"))


@query("SELECT issue_id, ingested_at, floor(epoch(ingested_at))::BIGINT - floor(epoch(created_at))::BIGINT AS seconds_late FROM issues WHERE created_at IS NOT NULL")
def s27_times(spark, root):
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return table(spark, root, "issues").where("created_at is not null").select("issue_id", "ingested_at", (sec("ingested_at") - sec("created_at")).alias("seconds_late"))


@query("SELECT file_id, sha256(content) AS hash, content_hash IS NOT NULL AND content_hash = sha256(content) AS recorded FROM files WHERE content IS NOT NULL")
def s27_hashes(spark, root):
    h = F.sha2("content", 256)
    return table(spark, root, "files").where("content is not null").select("file_id", h.alias("hash"), F.coalesce(F.col("content_hash") == h, F.lit(False)).alias("recorded"))


@query("SELECT issue_id, ingested_at, concat_ws(chr(10), 'RULE: ' || coalesce(rule, ''), 'EVIDENCE: ' || coalesce(evidence, ''), 'REASON: ' || left(coalesce(issue, ''), 700)) AS asked FROM issues")
def s27_query_builder(spark, root):
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    return table(spark, root, "issues").select("issue_id", "ingested_at", F.concat_ws("\n", part("RULE", F.col("rule")), part("EVIDENCE", F.col("evidence")), part("REASON", F.substring("issue", 1, 700))).alias("asked"))


@query("SELECT project_id, array_to_string(list_slice(list_sort(languages), 1, 2), ',') AS first_two, list_contains(languages, 'java') AS has_java, len(languages)::INT AS n FROM projects WHERE languages IS NOT NULL")
def s27_arrays(spark, root):
    return table(spark, root, "projects").where("languages is not null").select("project_id", F.array_join(F.slice(F.array_sort("languages"), 1, 2), ",").alias("first_two"), F.array_contains("languages", "java").alias("has_java"), F.size("languages").alias("n"))


# Texts put together from columns: sections of a record without the empty ones, and the request to a reviewer.
_SECTIONS = {"Rule": "rule", "Category": "category", "Severity": "severity", "What": "issue", "Fix": "fix_suggestion", "Evidence": "evidence", "Missing": "missing_control"}


@query("SELECT issue_id, ingested_at, concat_ws(chr(10), " + ", ".join(f"CASE WHEN trim({c}) <> '' THEN '{n}: ' || trim({c}) END" for n, c in _SECTIONS.items()) + ") AS content FROM issues")
def s27_record_text(spark, root):
    parts = [F.when(F.trim(c) != "", F.concat(F.lit(f"{n}: "), F.trim(c))) for n, c in _SECTIONS.items()]
    return table(spark, root, "issues").select("issue_id", "ingested_at", F.concat_ws("\n", *parts).alias("content"))


@query("SELECT project_id, file_id, md5('Review the file ' || path || '.' || chr(10) || 'Report only what the text shows.' || chr(10) || '---' || chr(10) || left(content, 6000)) AS prompt_md5 FROM files WHERE content <> ''")
def s27_prompts(spark, root):
    head = F.concat(F.lit("Review the file "), "path", F.lit(".\nReport only what the text shows.\n---\n"))
    return table(spark, root, "files").where("content <> ''").select("project_id", "file_id", F.md5(F.concat(head, F.left("content", F.lit(6000)))).alias("prompt_md5"))


@query("SELECT file_id, md5(regexp_replace(content, '(?m)^([ \\t]*)(\\w+) = open\\(([^\\n()]*)\\)$', '\\1\\2 = open(\\3)\\n\\1try:\\n\\1    pass\\n\\1finally:\\n\\1    \\2.close()', 'g')) AS fixed_md5 FROM files WHERE content IS NOT NULL AND lower(path) LIKE '%.py'".replace("\\n\\1", "' || chr(10) || '\\1"))
def s210_cleanup_rewrite(spark, root):
    """A file opened to a name gets a "finally" that closes it."""
    new = "$1$2 = open($3)\n$1try:\n$1    pass\n$1finally:\n$1    $2.close()"
    return table(spark, root, "files").where("content is not null and lower(path) like '%.py'").select("file_id", F.md5(F.regexp_replace("content", r"(?m)^([ \t]*)(\w+) = open\(([^\n()]*)\)$", new)).alias("fixed_md5"))


@query("SELECT issue_id, ingested_at, rule IN ('hardcoded_secret', 'sql_concat') AND length(evidence) > 3 AS usable, regexp_matches(evidence, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$') AS is_mail, length(evidence) >= 8 AND regexp_matches(evidence, '[A-Za-z]') AND regexp_matches(evidence, '[0-9]') AS strong FROM issues WHERE evidence IS NOT NULL AND rule IS NOT NULL")
def s27_policies(spark, root):
    e = F.col("evidence")
    return table(spark, root, "issues").where("evidence is not null and rule is not null").select(
        "issue_id", "ingested_at", (F.col("rule").isin("hardcoded_secret", "sql_concat") & (F.length(e) > 3)).alias("usable"), e.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$").alias("is_mail"),
        ((F.length(e) >= 8) & e.rlike("[A-Za-z]") & e.rlike("[0-9]")).alias("strong"))
