"""Queries on rule matches, findings and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions import paths
from orelode.operators import findings as fi
from orelode.operators import rules, scoring
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


def sources(spark: SparkSession, root: str, *more: str) -> DataFrame:
    """Files with the language that their path tells."""
    return table(spark, root, "files").select("file_id", "project_id", "path", "file_ord", "content", *more).withColumn("language", paths.language(F.col("path")))


_LANG = "CASE lower(regexp_extract(path, '\\.[^./]*$')) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.hpp' THEN 'cpp' ELSE 'other' END"


# A text with a match and one with a near miss, for each rule that the given files hardly ever break. They stand, with p_size empty lines before them, beside the files.
CASES = {
    "hardcoded_secret": ("api_key = 'zq81xkd0'", "password = 'changeme1'"), "dangerous_eval_py": ("y = eval(x)", "s = 'eval(x)'  # eval(x)"), "dangerous_eval_js": ("var y = eval(x);", "// eval(x)"),
    "empty_exception_handler_py": ("try:\n    a()\nexcept:\n    pass", "except ValueError:"), "empty_exception_handler_js": ("try { a() } catch (e) { }", "catch (e) { log(e) }"),
    "sql_concat": ("cur.execute(\"SELECT a FROM t WHERE b = \" + name)", "msg = \"select this: \" + name"), "tls_verification_disabled_js": ("process.env.NODE_TLS_REJECT_UNAUTHORIZED = '0'", "// NODE_TLS_REJECT_UNAUTHORIZED = 0"),
    "subprocess_shell_true_js": ("child_process.exec(cmd)", "re.exec(s)"), "spawn_shell_true_js": ("spawn('ls', args, { shell: true })", "spawn('ls', args, { shell: false })"),
    "ssrf_untrusted_url_js": ("axios.get(req.query.url)", "axios.get('https://a')"), "permissive_cors_js": ("app.use(cors({ credentials: true, origin: '*' }))", "app.use(cors({ origin: '*' }))"),
    "unsafe_deserialization_js": ("const s = require('node-serialize')", "serialize(a)"), "todo_marker": ("x = 1  # TODO later", "todo_list = 1"),
    "insecure_auth_cookie_js": ("res.cookie('session_id', v, { httpOnly: false })", "res.cookie('session_id', v, { httpOnly: true })"), "nosql_untrusted_filter_js": ("const u = User.findOne(req.body)", "list.find(req.body)"),
    "unsafe_archive_extract_js": ("zip.extractAllTo(req.body.dir)", "zip.extractAllTo('out')"), "xss_unsafe_html_sink_js": ("el.innerHTML = req.query.q;", "el.innerHTML = '';"),
    "react_dangerous_html_js": ("<p dangerouslySetInnerHTML={{ __html: x }} />", "const dangerouslySetInnerHTML = 1"), "debug_config_enabled_js": ("start({ debug: true })", "start({ debug: false })"),
    "weak_crypto_hash_js": ("// password\nconst h = createHash('md5')", "const h = createHash('md5')"), "insecure_random_secret_js": ("const token = Math.random()", "const x = Math.random()"),
    "sensitive_logging_js": ("console.log('x', password)", "console.log('x')"), "blocking_call_in_async_js": ("async function f() { fs.readFileSync(p) }", "function f() { fs.readFileSync(p) }"),
    "unsafe_tempfile_js": ("const p = os.tmpdir() + '/x'", "const p = os.tmpdir()"), "unsafe_redirect_js": ("res.redirect(req.query.next)", "res.redirect('/home')"),
    "frontend_token_storage_js": ("localStorage.setItem('jwt', t)", "localStorage.setItem('theme', t)"), "plaintext_password_handling_js": ("const password = req.body.password", "const password = hash(x)"),
    "mongoose_money_number_no_validation_js": ("amount: { type: Number }", "amount: { type: Number, min: 0 }"), "js_numeric_coercion_default_js": ("const n = Number(x) || 0", "const n = Number(x)"),
    "js_date_slice_without_validation_js": ("row.createdAt.slice(0, 10)", "row.name.slice(0, 10)"), "js_zero_baseline_fallback_js": ("if (!previous) return 0;", "if (!other) return 0;"),
    "js_unknown_type_default_js": ("if (a.type === 'x') { b() } else { c() }", "if (a.type === 'x') { b() }"), "process_global_auth_cache_js": ("let cachedUser\ncachedUser = req.user = u", "let user"),
    "nosql_untrusted_filter_py": ("db.users.find_one(request.json)", "names.find(request.json)"), "unsafe_archive_extract_py": ("zipfile.ZipFile(p).extractall(d)", "zipfile.ZipFile(p).namelist()"),
    "debug_config_enabled_py": ("app.run(debug=True)", "app.run(debug=False)"), "weak_crypto_hash_py": ("password_hash = hashlib.md5(x)", "h = hashlib.md5(x)"),
    "insecure_random_secret_py": ("token = random.choice(x)", "x = random.choice(y)"), "sensitive_logging_py": ("logger.info('t', token)", "logger.info('t')"),
    "blocking_call_in_async_py": ("async def f():\n    time.sleep(1)", "def f():\n    time.sleep(1)"), "unsafe_tempfile_py": ("p = tempfile.mktemp()", "p = tempfile.mkstemp()"),
    "unsafe_redirect_py": ("return redirect(request.args['next'])", "return redirect('/home')"), "plaintext_password_handling_py": ("password = request.form['p']", "password = hashed(p)"),
}


def _with_cases(spark: SparkSession, root: str, r: rules.Rule) -> DataFrame:
    """The files and the rule's cases: file_id, language, content."""
    yes, no = CASES[r.key]
    text = F.concat(F.repeat(F.lit("\n"), F.col("p_size")), F.when(F.col("p_partkey") % 2 == 0, yes).otherwise(no), F.lit("\n"))
    cases = table(spark, root, "part").select((-1 - F.col("p_partkey")).alias("file_id"), F.lit(r.languages[0]).alias("language"), text.alias("content"))
    return sources(spark, root).select("file_id", "language", "content").unionByName(cases)


def _rule_sql(r: rules.Rule) -> str:
    """All matches of a pattern by pieces, with the guards said in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    p = quoted(r.pattern)
    langs = ", ".join(f"'{x}'" for x in r.languages)
    head, tail = "regexp_extract(before, '[^\\n]*$')", "regexp_extract(after, '^[^\\n]*')"
    line = f"({head} || m || {tail})"
    near = lambda k: f"(right(before, length({head}) + {k}) || m || left(after, length({tail}) + {k}))"
    above = f"(regexp_extract(before, '(?:[^\\n]*\\n){{0,2}}[^\\n]*$') || m || {tail})"
    value, names = f"regexp_replace(lower(regexp_extract(m, {p}, 2)), '[\\s_\\-]', '', 'g')", ", ".join(f"'{x}'" for x in rules.PLACEHOLDERS)
    outside = lambda lexemes, marks: f"NOT regexp_matches(regexp_replace(before, {quoted(lexemes)}, '', 'g'), {quoted(marks)})"
    py, js = outside(rules.PY_LEXEMES, "[\"'#]"), outside(rules.JS_LEXEMES, "[\"'`]|//|/\\*")
    say = {
        "real_value": f"{value} NOT IN ({names}) AND regexp_replace({value}, '[0-9]+$', '') NOT IN ({names}) AND len(list_distinct(string_split({value}, ''))) > 1",
        "no_sample": f"NOT regexp_matches(trim({line}), '^\\s*(#|//|/\\*|\\*)') AND NOT regexp_matches(regexp_replace({near(180)}, {quoted(rules.SAMPLE_HOST)}, '', 'g'), {quoted(rules.SAMPLE_WORD)})",
        "python_code": f"(l <> 'python' OR {py})", "code": f"CASE WHEN l = 'python' THEN {py} ELSE {js} END", "sql_sink": f"regexp_matches({near(250)}, {quoted(rules.SQL_SINK)})",
        "hash_context": f"regexp_matches({above}, {quoted(rules.HASH_WORD)})", "token_context": f"regexp_matches({above}, {quoted(rules.TOKEN_WORD)})", "open_cookie": "regexp_matches(m, '(?i)\\b(httpOnly|secure)\\s*:\\s*false\\b')",
    }
    yes, no = (quoted(x) for x in CASES[r.key])
    return f"""
WITH c AS (SELECT file_id, content, {_LANG} AS l FROM files UNION ALL
  SELECT -1 - p_partkey, repeat(chr(10), p_size) || CASE WHEN p_partkey % 2 = 0 THEN {yes} ELSE {no} END || chr(10), '{r.languages[0]}' FROM part),
s AS (SELECT file_id, l, content, string_split_regex(content, {p}) AS pieces, regexp_extract_all(content, {p}) AS ms FROM c WHERE l IN ({langs}) AND regexp_matches(content, {p})),
e AS (SELECT file_id, l, content, ms[i] AS m, array_to_string(list_transform(range(1, i + 1), lambda k: pieces[k] || CASE WHEN k < i THEN ms[k] ELSE '' END), '') AS before FROM s, LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i)),
a AS (SELECT *, substr(content, length(before) + length(m) + 1) AS after FROM e)
SELECT file_id, (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line, substr(m, 1, 120) AS evidence FROM a WHERE {" AND ".join(say[g] for g in r.guards) or "true"}"""


def _rule_query(r: rules.Rule):
    def run(spark, root):
        return rules.scan(_with_cases(spark, root, r), ["file_id"], (r,)).select("file_id", "line", "evidence")

    return run


for _r in rules.RULES:
    QUERIES[f"s28_{_r.key}"] = _rule_query(_r)
    if rules.re2(_r.pattern):
        ORACLES[f"s28_{_r.key}"] = _rule_sql(_r)


@query("SELECT file_id, count(*)::INT AS lines_with_todo FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS l FROM files) WHERE regexp_matches(l, '(?i)#\\s*(TODO|FIXME)|//\\s*(TODO|FIXME)') GROUP BY 1")
def s28_match_lines(spark, root):
    todo = tuple(r for r in rules.RULES if r.name == "todo_marker")
    return rules.scan(sources(spark, root), ["file_id"], todo).groupBy("file_id").agg(F.count_distinct("line").cast("int").alias("lines_with_todo"))


@query("SELECT rule_key, severity, category, len(languages)::INT AS languages FROM (VALUES " + ", ".join(f"('{r.key}', '{r.severity}', '{r.category}', {list(r.languages)!r})" for r in rules.RULES) + ") t(rule_key, severity, category, languages)")
def s213_catalogue(spark, root):
    return rules.catalogue(spark).select("rule_key", "severity", "category", F.size("languages").alias("languages"))


@query()
def s28_all_rules(spark, root):
    return rules.scan(sources(spark, root), ["file_id", "project_id", "path", "file_ord"])


def issues(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "issues")


_CANON = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in fi.CANONICAL.items()) + ") canon(rule, rule_id)"
_CWE = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in fi.CWE.items()) + ") cwe(rule_id, cwe)"
_STD = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in scoring.STANDARD.items()) + ") std(rule, standard)"
_DIM = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in scoring.DIMENSION.items()) + ") dim(category, dimension)"
_SQZ = "lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"


@query(f"SELECT issue_id, ingested_at, rule_id FROM issues JOIN {_CANON} USING (rule)")
def s23_rule_family(spark, root):
    return issues(spark, root).select("issue_id", "ingested_at", fi.looked_up(fi.CANONICAL, F.col("rule")).alias("rule_id")).where("rule_id is not null")


@query(f"SELECT issue_id, ingested_at, rule_id, cwe, true AS deterministic_evidence, CASE rule_id WHEN 'SEC-HARDCODED-SECRET' THEN 'literal_secret' ELSE 'ast_call' END AS evidence_type FROM issues JOIN {_CANON} USING (rule) JOIN {_CWE} USING (rule_id) WHERE file <> '' AND line > 0")
def s23_gate_with_weakness(spark, root):
    return fi.gate(issues(spark, root)).select("issue_id", "ingested_at", "rule_id", "cwe", "deterministic_evidence", "evidence_type")


@query(f"SELECT issue_id, ingested_at, standard FROM issues LEFT JOIN {_STD} USING (rule)")
def s23_rule_standard(spark, root):
    return issues(spark, root).select("issue_id", "ingested_at", fi.looked_up(scoring.STANDARD, F.col("rule")).alias("standard"))


@query(f"SELECT issue_id, ingested_at, dimension FROM issues LEFT JOIN {_DIM} USING (category)")
def s23_category_dimension(spark, root):
    return issues(spark, root).select("issue_id", "ingested_at", fi.looked_up(scoring.DIMENSION, F.col("category")).alias("dimension"))


@query("SELECT issue_id, ingested_at, CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END AS deduction FROM issues")
def s23_severity_deduction(spark, root):
    return issues(spark, root).select("issue_id", "ingested_at", scoring.deduction(F.col("severity")).alias("deduction"))


@query("SELECT i.issue_id, i.ingested_at, max(length(f.content))::INT AS n_chars FROM issues i LEFT JOIN files f ON f.project_id = i.project_id AND f.path = i.file GROUP BY 1, 2")
def s23_finding_content(spark, root):
    bodies = table(spark, root, "files").groupBy("project_id", F.col("path").alias("file")).agg(F.max(F.length("content")).alias("n_chars"))
    return issues(spark, root).join(bodies, ["project_id", "file"], "left").groupBy("issue_id", "ingested_at").agg(F.max("n_chars").alias("n_chars"))


@query("SELECT a.issue_id AS issue_id, b.issue_id AS other_id, count(*) AS n FROM issues a JOIN issues b ON a.project_id = b.project_id AND a.file = b.file AND abs(a.line - b.line) <= 2 WHERE a.source = 'ai_quality' AND b.source = 'deterministic' GROUP BY 1, 2")
def s23_band_join_2_lines(spark, root):
    i = issues(spark, root).select("issue_id", "project_id", "file", "line", "source").where("line is not null")
    left, right = i.where("source = 'ai_quality'"), i.where("source = 'deterministic'").withColumnRenamed("issue_id", "other_id")
    return fi.near_pairs(left.drop("source"), right.drop("source"), ["project_id", "file"], 2).groupBy("issue_id", "other_id").agg(F.count("*").alias("n"))


@query("SELECT a.issue_id AS issue_id, b.issue_id AS other_id, count(*) AS n FROM issues a JOIN issues b ON a.project_id = b.project_id AND a.file = b.file AND abs(a.line - b.line) <= 5 AND a.issue_id < b.issue_id WHERE a.source = 'ai_quality' AND b.source = 'ai_quality' GROUP BY 1, 2")
def s23_band_self_join_5_lines(spark, root):
    i = issues(spark, root).where("source = 'ai_quality' and line is not null").select("issue_id", "project_id", "file", "line")
    return fi.near_pairs(i, i.withColumnRenamed("issue_id", "other_id"), ["project_id", "file"], 5).where("issue_id < other_id").groupBy("issue_id", "other_id").agg(F.count("*").alias("n"))


_TOK = "list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda x: lower(x)))"


@query(f"SELECT DISTINCT a.issue_id FROM issues a WHERE a.source = 'ai_quality' AND NOT EXISTS (SELECT 1 FROM issues b WHERE b.source = 'deterministic' AND b.project_id = a.project_id AND b.file = a.file AND b.line = a.line AND len(list_intersect({_TOK.format('a.issue')}, {_TOK.format('b.issue')})) >= 2)")
def s23_anti_join_shared_words(spark, root):
    from orelode.functions.text import tokens
    i = issues(spark, root)
    a = i.where("source = 'ai_quality'").select("issue_id", "project_id", "file", "line", tokens(F.col("issue")).alias("t"))
    b = i.where("source = 'deterministic'").select(F.col("project_id").alias("p"), F.col("file").alias("f"), F.col("line").alias("l"), tokens(F.col("issue")).alias("u"))
    same = (F.col("p") == F.col("project_id")) & (F.col("f") == F.col("file")) & (F.col("l") == F.col("line")) & (F.size(F.array_intersect("t", "u")) >= 2)
    return a.join(b, same, "left_anti").select("issue_id").distinct()


@query("SELECT project_id, dimension, greatest(0, 100 - sum(d))::INT AS score, count(*)::INT AS finding_count FROM (SELECT project_id, dimension, CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END AS d FROM issues JOIN " + _DIM + " USING (category)) GROUP BY 1, 2")
def s24_category_scores(spark, root):
    return scoring.category_scores(issues(spark, root))


_WORDS = lambda ws: " OR ".join(f"contains(lower(content), '{w}')" for w in ws)
_PARTS = "list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p <> '' AND p <> '.')"
_BASE = f"list_extract({_PARTS}, -1)"
_SCORES = f"""
WITH facts AS (SELECT project_id, count(*) AS files, bool_or(list_contains(string_split(replace(path, '\\', '/'), '/'), 'services')) AS service_layer,
  bool_or(list_has_any({_PARTS}, ['tests', '__tests__']) OR regexp_matches({_BASE}, '^(test_.*\\.py|.*_test\\.py|.*\\.(test|spec)\\.(js|jsx|ts|tsx))$')) AS tests,
  bool_or({_BASE} IN ('requirements.txt', 'pyproject.toml', 'package.json', 'setup.py', 'pom.xml', 'build.gradle', '.env.example', 'tsconfig.json')) AS configs,
  bool_or({_BASE} IN ('Dockerfile', 'docker-compose.yml', 'docker-compose.yaml', 'render.yaml', 'vercel.json', 'Procfile') OR contains(path, '.github/workflows/')) AS deployment,
  bool_or(coalesce({_WORDS(scoring.VALIDATION_WORDS)}, false)) AS validation, bool_or(coalesce({_WORDS(scoring.BLOCKING_WORDS)}, false)) AS blocking FROM files GROUP BY 1),
ends AS (SELECT project_id, count(*) AS endpoints FROM symbols WHERE kind = 'method' GROUP BY 1),
found AS (SELECT project_id, dimension, greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END)) AS score, count(*) AS n FROM issues JOIN {_DIM} USING (category) GROUP BY 1, 2),
b AS (SELECT p.project_id, w.dimension, w.weight, coalesce(files, 0) AS files, coalesce(endpoints, 0) AS ends, coalesce(service_layer, false) AS sl, coalesce(tests, false) AS t, coalesce(configs, false) AS cf, coalesce(deployment, false) AS dp,
  coalesce(validation, false) AS v, coalesce(blocking, false) AS bl, coalesce(found.score, 100) AS fs, coalesce(found.n, 0) AS n, p.analysis_status IS NOT NULL AND p.analysis_status = 'partial' AS part
  FROM projects p CROSS JOIN (VALUES {", ".join(f"('{d}', {w})" for d, w in scoring.WEIGHTS.items())}) w(dimension, weight)
  LEFT JOIN facts USING (project_id) LEFT JOIN ends USING (project_id) LEFT JOIN found ON found.project_id = p.project_id AND found.dimension = w.dimension),
r AS (SELECT *, CASE dimension WHEN 'architecture' THEN (ends >= 5 AND NOT sl)::INT WHEN 'api_design' THEN (ends > 0 AND NOT v)::INT WHEN 'performance' THEN bl::INT WHEN 'testing' THEN (files > 0 AND NOT t)::INT WHEN 'production_readiness' THEN (NOT dp)::INT + (NOT cf)::INT ELSE 0 END AS extra,
  CASE dimension WHEN 'architecture' THEN fs - 15 * (ends >= 5 AND NOT sl)::INT WHEN 'api_design' THEN least(100 - 20 * (ends > 0 AND NOT v)::INT, fs) WHEN 'performance' THEN least(100 - 10 * bl::INT, fs) WHEN 'testing' THEN 100 - 40 * (files > 0 AND NOT t)::INT
    WHEN 'production_readiness' THEN fs - 20 * (NOT dp)::INT - 10 * (NOT cf)::INT ELSE fs END AS raw,
  CASE WHEN dimension = 'api_design' THEN CASE WHEN ends = 0 THEN 'not_evaluated' WHEN part THEN 'partial' ELSE 'evaluated' END WHEN files = 0 THEN 'not_evaluated' WHEN dimension IN ('performance', 'testing') THEN 'evaluated' WHEN part THEN 'partial' ELSE 'evaluated' END AS status FROM b),
scores AS (SELECT project_id, dimension, CASE WHEN status <> 'not_evaluated' THEN greatest(0, least(100, raw)) END::INT AS score, status, weight::DOUBLE AS weight,
  ((CASE WHEN dimension = 'testing' OR dimension = 'api_design' AND ends = 0 THEN 0 ELSE n END) + extra)::INT AS finding_count FROM r)
"""


def _scores(spark, root):
    facts = scoring.project_facts(table(spark, root, "files").select("project_id", "path", "content"), table(spark, root, "symbols").where("kind = 'method'").select("project_id"))
    projects = table(spark, root, "projects").select("project_id", "analysis_status")
    status = projects.groupBy("project_id").agg(F.max("analysis_status").alias("analysis_status"))
    return scoring.score(projects, status.join(facts, "project_id", "left"), issues(spark, root), F.coalesce(F.col("analysis_status") == "partial", F.lit(False)))


@query(_SCORES + "SELECT * FROM scores")
def s24_scores(spark, root):
    return _scores(spark, root)


@query(_SCORES + "SELECT project_id, floor((20 * sum(score * round(weight * 100)::BIGINT) + sum(CASE WHEN score IS NOT NULL THEN round(weight * 100)::BIGINT END)) / (2 * sum(CASE WHEN score IS NOT NULL THEN round(weight * 100)::BIGINT END))) / 10 AS overall_score, count(score)::INT AS dimensions_evaluated FROM scores GROUP BY 1")
def s24_overall(spark, root):
    return scoring.overall(_scores(spark, root))


for _d in scoring.WEIGHTS:
    def _one(spark, root, _d=_d):
        return _scores(spark, root).where(F.col("dimension") == _d)
    QUERIES[f"s211_{_d}"] = _one
    ORACLES[f"s211_{_d}"] = _SCORES + f"SELECT * FROM scores WHERE dimension = '{_d}'"


@query("SELECT project_id, file, sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)::INT AS risk FROM issues WHERE file <> '' GROUP BY 1, 2")
def s24_file_risk(spark, root):
    return scoring.file_risk(issues(spark, root))


@query("SELECT project_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM issues GROUP BY 1")
def s24_severity_counts(spark, root):
    return scoring.severity_counts(issues(spark, root), "project_id")


@query(f"SELECT project_id, count(*) AS files, count(*) FILTER (content IS NOT NULL) AS with_text, count(*) FILTER (content = '') AS empty, count(*) FILTER ({_LANG} <> 'other') AS source_files, count(*) FILTER (length(content) > 100000) AS large, CASE WHEN count(*) = count(*) FILTER (content IS NOT NULL) THEN 'complete' ELSE 'partial' END AS coverage FROM files GROUP BY 1")
def s24_coverage(spark, root):
    return sources(spark, root).groupBy("project_id").agg(
        F.count("*").alias("files"), F.count("content").alias("with_text"), F.count_if(F.col("content") == "").alias("empty"), F.count_if(F.col("language") != "other").alias("source_files"), F.count_if(F.length("content") > 100_000).alias("large"),
        F.when(F.count("*") == F.count("content"), "complete").otherwise("partial").alias("coverage"))


@query("WITH t AS (SELECT category = 'security' AS truth, severity IN ('critical', 'high') AS said FROM issues WHERE category IS NOT NULL AND severity IS NOT NULL), c AS (SELECT count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM t) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) AS f1, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr FROM c")
def s24_precision_recall(spark, root):
    i = issues(spark, root).where("category is not null and severity is not null")
    return scoring.quality(i, F.col("severity").isin("critical", "high"), F.col("category") == "security")


@query("SELECT project_id, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM issues WHERE file <> '' AND severity = 'critical' GROUP BY 1")
def s24_distinct_sets(spark, root):
    return issues(spark, root).where("file <> '' and severity = 'critical'").groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


@query("SELECT count(*) AS findings, count(DISTINCT finding_id) AS ids, count(DISTINCT project_id) AS projects FROM issues")
def s24_counts(spark, root):
    return issues(spark, root).agg(F.count("*").alias("findings"), F.count_distinct("finding_id").alias("ids"), F.count_distinct("project_id").alias("projects"))


@query("SELECT project_id, file, risk FROM (SELECT project_id, file, risk, row_number() OVER (PARTITION BY project_id ORDER BY risk DESC, file) AS n FROM (SELECT project_id, file, sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)::INT AS risk FROM issues WHERE file <> '' GROUP BY 1, 2)) r WHERE n <= 5 AND EXISTS (SELECT 1 FROM files f WHERE f.project_id = r.project_id AND f.path = r.file)")
def s25_risk_ranking(spark, root):
    from orelode.operators.retrieval import top
    ranked = top(scoring.file_risk(issues(spark, root)), ["project_id"], [F.desc("risk"), "file"], 5)
    there = table(spark, root, "files").select("project_id", F.col("path").alias("file"))
    return ranked.join(there, ["project_id", "file"], "left_semi").select("project_id", "file", "risk")


@query("SELECT project_id, issue_id FROM (SELECT DISTINCT project_id, issue_id, severity FROM issues WHERE severity IN ('critical', 'high', 'medium', 'low')) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, issue_id) <= 5")
def s25_top_priorities(spark, root):
    from orelode.operators.retrieval import top
    i = issues(spark, root).where(F.col("severity").isin(*scoring.DEDUCTION)).select("project_id", "issue_id", "severity").distinct()
    return top(i, ["project_id"], [F.desc(fi.severity_rank(F.col("severity"))), "issue_id"], 5).select("project_id", "issue_id")


@query("SELECT project_id, file, line, rule, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS severity_rank, max_by(issue_id, (CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END, coalesce(confidence, -1), length(coalesce(evidence, '')) + length(coalesce(fix_suggestion, '')), -issue_id)) AS issue_id FROM issues WHERE isfinite(coalesce(confidence, 0)) GROUP BY 1, 2, 3, 4")
def s25_best_of_each(spark, root):
    rank = fi.severity_rank(F.col("severity"))
    order = F.struct(rank, F.coalesce("confidence", F.lit(-1.0)), F.length(F.coalesce("evidence", F.lit(""))) + F.length(F.coalesce("fix_suggestion", F.lit(""))), -F.col("issue_id"))
    return issues(spark, root).where("confidence is null or (not isnan(confidence) and abs(confidence) < double('infinity'))").groupBy("project_id", "file", "line", "rule").agg(F.max(rank).alias("severity_rank"), F.max_by("issue_id", order).alias("issue_id"))


@query(f"SELECT issue_id, substr(sha256(concat_ws(chr(31), coalesce(rule, ''), coalesce(file, ''), coalesce(line, 0)::VARCHAR, {_SQZ.format('evidence')})), 1, 24) AS stable_id, count(*) AS n FROM issues GROUP BY 1, 2")
def s26_stable_ids(spark, root):
    return issues(spark, root).select("issue_id", fi.stable_id(F.col("rule"), F.col("file"), F.col("line"), F.col("evidence")).alias("stable_id")).groupBy("issue_id", "stable_id").agg(F.count("*").alias("n"))


@query("SELECT project_id, file, line, rule, evidence, min(issue_id) AS issue_id FROM issues GROUP BY ALL")
def s26_exact_distinct(spark, root):
    return fi.exact_distinct(issues(spark, root), ["project_id"], ["issue_id", "ingested_at"]).select("project_id", "file", "line", "rule", "evidence", "issue_id")


@query()
def s26_semantic_merge(spark, root):
    i = issues(spark, root).select("project_id", "issue_id", "file", "line", "rule", "evidence", "ingested_at", F.when(F.col("source") == "deterministic", "ast_source_sink").otherwise("deterministic_pattern").alias("evidence_type"))
    return fi.merge_near(fi.exact_distinct(i, ["project_id"], ["issue_id", "ingested_at"]).drop("ingested_at"), ["project_id"], "issue_id")


_ROOT = f"CASE {' '.join(f'''WHEN rule = '{r}' THEN '{g}' ''' for r, g in fi.ROOT_OF_RULE.items())} {' '.join(f'''WHEN contains({_SQZ.format('concat_ws(chr(32), coalesce(rule, chr(0)), issue)')}, '{w}') THEN '{g}' ''' for w, g in fi.ROOT_OF_WORDS.items())} ELSE coalesce(nullif(category, ''), nullif(rule, ''), {_SQZ.format('''coalesce(rule, '') || ' ' || coalesce(issue, '')''')}) END".replace("coalesce(rule, chr(0))", "coalesce(rule, '')")


@query(f"SELECT issue_id, ingested_at, {_ROOT} AS root_group FROM issues")
def s26_root_groups(spark, root):
    return issues(spark, root).select("issue_id", "ingested_at", fi.root_group(F.col("rule"), F.col("issue"), F.col("category")).alias("root_group"))


@query(f"WITH k AS (SELECT project_id, issue_id, source, concat_ws(chr(31), coalesce(file, ''), {_ROOT}, floor(coalesce(line, 0) / 3)::BIGINT::VARCHAR, substr({_SQZ.format('evidence')}, 1, 90)) AS k FROM issues) SELECT project_id, k AS merge_key, min(issue_id) AS issue_id, array_to_string(list_sort(list_distinct(flatten(list(string_split(source, '+'))))), '+') AS source FROM k WHERE source <> '' GROUP BY 1, 2")
def s26_merge_by_key(spark, root):
    i = issues(spark, root).where("source <> ''")
    key = fi.merge_key(F.col("file"), fi.root_group(F.col("rule"), F.col("issue"), F.col("category")), F.col("line"), F.col("evidence"))
    return i.groupBy("project_id", key.alias("merge_key")).agg(F.min("issue_id").alias("issue_id"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("source"), lambda s: F.split(s, r"\+"))))), "+").alias("source"))


@query("SELECT coalesce(b.file, a.file) AS file, coalesce(b.rule, a.rule) AS rule, CASE WHEN a.file IS NULL THEN 'resolved' WHEN b.file IS NULL THEN 'new' ELSE 'remaining' END AS state FROM (SELECT DISTINCT file, rule FROM issues WHERE source = 'deterministic' AND file IS NOT NULL AND rule IS NOT NULL) b FULL JOIN (SELECT DISTINCT file, rule FROM issues WHERE source = 'ai_quality' AND file IS NOT NULL AND rule IS NOT NULL) a ON a.file = b.file AND a.rule = b.rule")
def s26_before_after(spark, root):
    i = issues(spark, root).where("file is not null and rule is not null")
    return fi.diff_keys(i.where("source = 'deterministic'"), i.where("source = 'ai_quality'"), ["file", "rule"])


@query("SELECT project_id FROM projects WHERE analysis_revision = source_revision")
def s212_freshness(spark, root):
    return table(spark, root, "projects").where("analysis_revision = source_revision").select("project_id")


@query("SELECT issue_id, ingested_at, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_word FROM issues WHERE isfinite(confidence)")
def s210_candidate_confidence(spark, root):
    c = F.col("confidence")
    return issues(spark, root).where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))).select("issue_id", "ingested_at", F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low").alias("confidence_word"))


@query("SELECT issue_id, ingested_at, CASE severity WHEN 'high' THEN 'critical' ELSE severity END AS issue_severity, 0.65::DOUBLE AS issue_confidence, severity IN ('high', 'critical') AS review FROM issues WHERE source = 'deterministic'")
def s210_finding_to_issue(spark, root):
    s = F.col("severity")
    return issues(spark, root).where("source = 'deterministic'").select("issue_id", "ingested_at", F.when(s == "high", "critical").otherwise(s).alias("issue_severity"), F.lit(0.65).alias("issue_confidence"), s.isin("high", "critical").alias("review"))


@query("SELECT issue_id, ingested_at, round(CASE WHEN category = 'security' AND line IS NULL THEN greatest(0, confidence - 0.2) ELSE confidence END, 4) AS sane_confidence, severity = 'critical' AND (CASE WHEN category = 'security' AND line IS NULL THEN greatest(0, confidence - 0.2) ELSE confidence END) < 0.5 AS to_human FROM issues WHERE confidence BETWEEN 0 AND 1")
def s210_confidence_sanity(spark, root):
    c = F.when((F.col("category") == "security") & F.col("line").isNull(), F.greatest(F.lit(0.0), F.col("confidence") - 0.2)).otherwise(F.col("confidence"))
    return issues(spark, root).where("confidence between 0 and 1").select("issue_id", "ingested_at", F.round(c, 4).alias("sane_confidence"), ((F.col("severity") == "critical") & (c < 0.5)).alias("to_human"))


_TOKEN_SETS = f"SELECT a.issue_id, len(list_intersect({_TOK.format('a.issue')}, {_TOK.format('a.fix_suggestion')}))::INT AS shared, len(list_filter({_TOK.format('a.issue')}, lambda x: NOT list_contains({_TOK.format('a.fix_suggestion')}, x)))::INT AS only_issue, count(*) AS n FROM issues a GROUP BY ALL"


@query(_TOKEN_SETS)
def s26_token_sets(spark, root):
    from orelode.functions.text import tokens
    a, b = tokens(F.col("issue")), tokens(F.col("fix_suggestion"))
    return issues(spark, root).groupBy("issue_id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_except(a, b)).alias("only_issue")).agg(F.count("*").alias("n"))
