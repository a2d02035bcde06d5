"""Queries on ranking, windows over lines, import graphs and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions import paths, text
from orelode.operators import retrieval as re_
from orelode.sources.tables import small_rows, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, root: str) -> DataFrame:
    """One row per path of a project: the first stored."""
    f = table(spark, root, "files").select("file_id", "project_id", "path", "file_ord", "content")
    return f.groupBy("project_id", "path").agg(F.min_by(F.struct("file_id", "file_ord", "content"), F.struct("file_ord", "file_id")).alias("f")).select("project_id", "path", "f.file_id", "f.file_ord", "f.content")


def imports(spark: SparkSession, root: str) -> DataFrame:
    """What python_modules recorded; and, since hardly any of it leads to a file of these tables, for every file an import of the next file of its project by dotted path."""
    from pyspark.sql import Window
    m = table(spark, root, "python_modules")
    nxt = F.lead("path").over(Window.partitionBy("project_id").orderBy("file_ord", "file_id"))
    chain = files(spark, root).select("project_id", F.col("path").alias("file"), nxt.alias("to")).select("project_id", "file", F.replace(F.regexp_replace("to", re_.EXTENSION, ""), F.lit("/"), F.lit(".")).alias("module"))
    recorded = m.select("project_id", "file", F.explode(F.concat(F.coalesce("imports", F.array().cast("array<string>")), F.coalesce("from_imports", F.array().cast("array<string>")))).alias("module"))
    return recorded.unionByName(chain).where("module <> ''").distinct()


def questions(spark: SparkSession, root: str) -> DataFrame:
    """A question for every project: what was said of its most severe finding's file."""
    i = table(spark, root, "issues").where("issue <> '' and file <> ''")
    return i.groupBy("project_id").agg(F.min_by(F.concat_ws(" ", "issue", "file"), F.struct("issue_id", "ingested_at")).alias("question"), F.min("issue_id").alias("question_id"))


_FILES = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY project_id, path ORDER BY file_ord, file_id) = 1)"
_IMPORTS = "m AS (SELECT DISTINCT project_id, file, module FROM (SELECT project_id, file, unnest(list_concat(coalesce(imports, []), coalesce(from_imports, []))) AS module FROM python_modules UNION ALL SELECT project_id, path, replace(regexp_replace(lead(path) OVER (PARTITION BY project_id ORDER BY file_ord, file_id), '\\.(py|js|jsx|ts|tsx)$', ''), '/', '.') FROM f) WHERE module <> '')"
_EDGES = f"""
WITH {_FILES}, {_IMPORTS},
st AS (SELECT project_id, path, regexp_replace(path, '\\.(py|js|jsx|ts|tsx)$', '') AS s FROM f WHERE regexp_matches(path, '\\.(py|js|jsx|ts|tsx)$')),
st2 AS (SELECT *, regexp_replace(s, '/(index|__init__)$', '') AS d FROM st),
k AS (SELECT project_id, path, key_ord, module_key FROM (SELECT project_id, path, unnest([s, d, replace(s, '/', '.'), replace(d, '/', '.')]) AS module_key, unnest([0, 1, 2, 3]) AS key_ord FROM st2)),
b AS (SELECT project_id, file, module, regexp_replace(file, '(^|/)[^/]*$', '') AS folder FROM m),
c AS (SELECT project_id, file, module, 1 AS try_ord, module AS module_key FROM b WHERE NOT starts_with(module, '.') UNION ALL
  SELECT project_id, file, module, 2, CASE WHEN folder = '' THEN module ELSE folder || '/' || replace(module, '.', '/') END FROM b WHERE NOT starts_with(module, '.')),
h AS (SELECT c.project_id, file, module, arg_min(path, (try_ord, key_ord, path)) AS dst FROM c JOIN k USING (project_id, module_key) WHERE path <> file GROUP BY 1, 2, 3),
e AS (SELECT DISTINCT project_id, file AS src, dst FROM h),
u AS (SELECT project_id, src AS path, dst AS related FROM e UNION SELECT project_id, dst, src FROM e)
"""


def edges(spark, root):
    return re_.import_edges(files(spark, root), imports(spark, root))


@query(_EDGES + "SELECT * FROM e")
def s29_import_graph(spark, root):
    return edges(spark, root)


@query(_EDGES + "SELECT project_id, path, related, 1 AS hop FROM u")
def s29_neighbours_1(spark, root):
    return re_.neighbours(edges(spark, root))


@query(_EDGES + ", p AS (SELECT project_id, path, related, 1 AS hop FROM u UNION ALL SELECT a.project_id, a.path, b.related, 2 FROM u a JOIN u b ON a.project_id = b.project_id AND a.related = b.path WHERE a.path <> b.related) SELECT project_id, path, related, min(hop)::INT AS hop FROM p GROUP BY 1, 2, 3")
def s29_neighbours_2(spark, root):
    return re_.neighbours(edges(spark, root), 2)


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_QTOK = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains(" + _STOP + ", x)))"
_BASE = "list_extract(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p <> '' AND p <> '.'), -1)"
_LIST = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_RANKED = f"""
, q AS (SELECT question_id, project_id, lower(question) AS asked, {_QTOK.format('question')} AS q FROM (SELECT project_id, arg_min(concat_ws(' ', issue, file), (issue_id, ingested_at)) AS question, min(issue_id) AS question_id FROM issues WHERE issue <> '' AND file <> '' GROUP BY 1)),
nm AS (SELECT project_id, file AS path, list(DISTINCT lower(name)) AS names FROM symbols WHERE name IS NOT NULL GROUP BY 1, 2),
im AS (SELECT project_id, file AS path, list(DISTINCT t) AS imported FROM (SELECT project_id, file, unnest({_QTOK.format('module')}) AS t FROM m) GROUP BY 1, 2),
j AS (SELECT question_id, f.project_id, f.path, f.file_ord, asked, q, lower(coalesce(content, '')) AS low, regexp_replace({_BASE.replace('path', 'f.path')}, '\\.[^.]*$', '') AS stem, coalesce(names, []) AS names, coalesce(imported, []) AS imported FROM f JOIN q USING (project_id) LEFT JOIN nm ON nm.project_id = f.project_id AND nm.path = f.path LEFT JOIN im ON im.project_id = f.project_id AND im.path = f.path),
r AS (SELECT question_id, project_id, path, file_ord, greatest(3 * len(list_intersect(q, {_QTOK.format("regexp_replace(stem, '[_-]', ' ', 'g')")})) + 2 * len(list_intersect(q, names)) + 2 * len(list_intersect(q, imported)) + CASE WHEN low <> '' THEN len(list_filter(q, lambda t: contains(low, t))) ELSE 0 END,
  CASE WHEN low <> '' AND list_has_any(q, [{", ".join(f"'{w}'" for w in re_.DB_WORDS)}]) AND lower(stem) IN {_LIST(re_.DB_STEMS)} THEN 8 ELSE 0 END,
  CASE WHEN low <> '' AND list_has_any(q, [{", ".join(f"'{w}'" for w in re_.DB_WORDS)}]) AND ({" OR ".join(f"contains(low, '{w}')" for w in re_.DB_MARKS)}) THEN 7 ELSE 0 END,
  CASE WHEN path <> '' AND contains(asked, lower(path)) THEN 10 ELSE 0 END)::INT AS score FROM j)
"""


def _ranked(spark, root):
    names = table(spark, root, "symbols").where("name is not null").select("project_id", "file", "name")
    return re_.rank_files(files(spark, root), questions(spark, root), names, imports(spark, root))


@query(_EDGES + _RANKED + "SELECT question_id, project_id, path, file_ord, score FROM r WHERE score > 0")
def s29_file_ranking(spark, root):
    return _ranked(spark, root)


def _seeds(spark, root):
    return re_.top(_ranked(spark, root), ["question_id"], [F.desc("score"), "file_ord", "path"], re_.TOP)


_SEEDS = ", seeds AS (SELECT question_id, project_id, path, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_ord, path) AS place FROM r WHERE score > 0 QUALIFY place <= 5)"


@query(_EDGES + _RANKED + _SEEDS + "SELECT question_id, project_id, path, score, place::INT AS place FROM seeds")
def s25_ranked_top_5(spark, root):
    return _seeds(spark, root).select("question_id", "project_id", "path", "score", "place")


@query(_EDGES + _RANKED + _SEEDS + """, n AS (SELECT s.question_id, s.project_id, u.related AS path, min((place, score)) AS mn FROM seeds s JOIN u ON u.project_id = s.project_id AND u.path = s.path WHERE EXISTS (SELECT 1 FROM f WHERE f.project_id = s.project_id AND f.path = u.related) AND NOT EXISTS (SELECT 1 FROM seeds t WHERE t.question_id = s.question_id AND t.path = u.related) GROUP BY 1, 2, 3),
a AS (SELECT question_id, project_id, path, score::DOUBLE AS score, place AS seen FROM seeds UNION ALL SELECT question_id, project_id, path, round(mn[2] * 0.5, 2)::DOUBLE, 1000 + mn[1] FROM n),
kept AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seen, path) AS i FROM a QUALIFY i <= 8)
SELECT question_id, project_id, path, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen, path)::INT AS place FROM kept""")
def s25_expansion_and_resort(spark, root):
    return re_.expanded(_seeds(spark, root), edges(spark, root), files(spark, root))


QUERIES["s29_expansion"] = s25_expansion_and_resort
ORACLES["s29_expansion"] = ORACLES["s25_expansion_and_resort"]


@query(f"SELECT project_id, min(issue_id) AS question_id, bool_or(list_has_any({_QTOK.format('issue')}, [{', '.join(repr(w) for w in re_.RISK)}])) AS asks_for_risk FROM issues WHERE issue <> '' GROUP BY 1")
def s29_risk_route(spark, root):
    i = table(spark, root, "issues").where("issue <> ''")
    return i.groupBy("project_id").agg(F.min("issue_id").alias("question_id"), F.bool_or(F.arrays_overlap(text.question_tokens(F.col("issue")), F.array(*map(F.lit, re_.RISK)))).alias("asks_for_risk"))


@query(_EDGES + ", q AS (SELECT project_id, lower(issue || ' ' || coalesce(file, '')) AS asked, issue_id FROM issues WHERE issue <> '') SELECT DISTINCT q.project_id, issue_id, f.path FROM q JOIN f USING (project_id) WHERE f.path <> '' AND contains(asked, lower(f.path))")
def s23_path_mentions(spark, root):
    q = table(spark, root, "issues").where("issue <> ''").select("project_id", "issue_id", F.concat("issue", F.lit(" "), F.coalesce("file", F.lit(""))).alias("text"))
    return re_.path_mentions(q, table(spark, root, "files"), ["issue_id"])


def _near_file(spark, root):
    i = table(spark, root, "issues").select("issue_id", "project_id", F.col("file").alias("path"), F.coalesce("line", F.lit(0)).alias("line")).distinct()
    return i.join(files(spark, root).select("project_id", "path", "content").where("content <> ''"), ["project_id", "path"])


def _frame_sql(before: int, after: int, head: int) -> str:
    return f"WITH {_FILES}, i AS (SELECT DISTINCT issue_id, project_id, file AS path, coalesce(line, 0) AS line FROM issues) SELECT issue_id, project_id, path, line, md5(CASE WHEN line > 0 THEN array_to_string(list_slice(string_split(content, chr(10)), greatest(1, line - {before}), line + {after}), chr(10)) ELSE array_to_string(list_slice(string_split(content, chr(10)), 1, {head}), chr(10)) END) AS snippet_md5 FROM i JOIN f USING (project_id, path) WHERE content <> ''"


def _frame(spark, root, before: int, after: int, head: int) -> DataFrame:
    return _near_file(spark, root).select("issue_id", "project_id", "path", "line", F.md5(text.frame(F.col("content"), F.col("line"), before, after, head)).alias("snippet_md5"))


@query(_frame_sql(8, 8, 16))
def s25_snippet_8(spark, root):
    return _frame(spark, root, 8, 8, 16)


@query(_frame_sql(5, 5, 10))
def s25_snippet_5(spark, root):
    return _frame(spark, root, 5, 5, 10)


@query(_frame_sql(2, 2, 5))
def s25_issue_context(spark, root):
    return _frame(spark, root, 2, 2, 5)


@query(_EDGES + ", bud AS (SELECT u.project_id, u.path, u.related, least(1200, length(content)) AS n FROM u JOIN f ON f.project_id = u.project_id AND f.path = u.related WHERE content <> ''), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project_id, path ORDER BY related ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM bud) SELECT project_id, path, related, least(n, 6000 - used)::INT AS taken FROM w WHERE used < 6000")
def s25_context_budget(spark, root):
    from pyspark.sql import Window
    sizes = files(spark, root).where("content <> ''").select("project_id", F.col("path").alias("related"), F.least(F.lit(1200), F.length("content")).alias("n"))
    near = re_.neighbours(edges(spark, root)).join(sizes, ["project_id", "related"])
    used = F.coalesce(F.sum("n").over(Window.partitionBy("project_id", "path").orderBy("related").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("used", used).where("used < 6000").select("project_id", "path", "related", F.least("n", 6000 - F.col("used")).cast("int").alias("taken"))


QUERIES["s29_finding_context"] = s25_context_budget
ORACLES["s29_finding_context"] = ORACLES["s25_context_budget"]


def _vectors(spark, root):
    return table(spark, root, "embeddings")


def _queries(spark, root, n: int = 3):
    """The first vectors, as questions. Their number is fixed."""
    return [(r["vec_id"], list(r["embedding"])) for r in small_rows(_vectors(spark, root).where(F.col("vec_id") < n).orderBy("vec_id"))]


_SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT q.vec_id AS query_id, a.vec_id, a.label, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, a.vec_id)::INT AS place FROM embeddings a, embeddings q WHERE q.vec_id < 3 QUALIFY place <= 10")
def s29_vector_search(spark, root):
    return re_.nearest(_vectors(spark, root), _queries(spark, root), 10)


@query(f"WITH t AS (SELECT q.vec_id AS query_id, a.vec_id, a.label, {_SIM} AS similarity FROM embeddings a, embeddings q WHERE q.vec_id < 3 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, a.vec_id) <= 40) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS place FROM t WHERE similarity >= 0.55 QUALIFY place <= 8")
def s25_over_fetch_then_cut(spark, root):
    return re_.nearest(_vectors(spark, root), _queries(spark, root), 8, 0.55, 40)


@query(f"SELECT q.vec_id AS query_id, a.vec_id, a.label, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, a.vec_id)::INT AS place FROM embeddings a, embeddings q WHERE q.vec_id < 3 AND a.label <> q.label QUALIFY place <= 2")
def s29_other_projects(spark, root):
    """The nearest two of another label: its own are dropped before the cut."""
    q = _queries(spark, root)
    own = {r["vec_id"]: r["label"] for r in small_rows(_vectors(spark, root).where(F.col("vec_id") < 3).select("vec_id", "label"))}
    out = None
    for i, v in q:
        part = re_.nearest(_vectors(spark, root).where(F.col("label") != own[i]), [(i, v)], 2)
        out = part if out is None else out.union(part)
    return out


QUERIES["s23_vector_join"] = s29_vector_search
ORACLES["s23_vector_join"] = ORACLES["s29_vector_search"]

# Knowledge retrieval: the documents of a language stand in for records, findings for questions.
_KTOK = "list_distinct(list_filter(list_transform(list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda x: lower(x)), lambda x: CASE WHEN length(x) > 4 AND ends_with(x, 's') THEN left(x, length(x) - 1) ELSE x END), lambda x: NOT list_contains(" + _STOP + ", x)))"
_RECORDS = f"rec AS (SELECT item_id, lower(suite) AS suite, {_KTOK.format('text')} AS t FROM eval_items WHERE text <> '')"
_ASKED = f"ask AS (SELECT doc_id, lower(lang) AS lang, {_KTOK.format('text')} AS q FROM documents WHERE doc_id % 100 = 0 AND text <> '')"


def _records(spark, root):
    return table(spark, root, "eval_items").where("text <> ''").select("item_id", F.lower("suite").alias("suite"), text.singular_tokens(F.col("text")).alias("t"))


def _asked(spark, root):
    return table(spark, root, "documents").where("doc_id % 100 = 0 and text <> ''").select("doc_id", F.lower("lang").alias("lang"), text.singular_tokens(F.col("text")).alias("q"))


def _overlap(spark, root):
    """(doc_id, item_id, shared): an equi-join on the token, so no pair without a shared word arises."""
    a = _asked(spark, root).select("doc_id", F.size("q").alias("asked"), F.explode("q").alias("w"))
    r = _records(spark, root).select("item_id", F.explode("t").alias("w"))
    return a.join(r, "w").groupBy("doc_id", "item_id").agg(F.count("*").cast("int").alias("shared"), F.first("asked").alias("asked"))


@query(f"WITH {_RECORDS}, {_ASKED} SELECT doc_id, item_id, len(list_intersect(q, t))::INT AS shared FROM ask, rec WHERE len(list_intersect(q, t)) > 0")
def s23_token_overlap(spark, root):
    return _overlap(spark, root).select("doc_id", "item_id", "shared")


@query(f"WITH {_RECORDS}, {_ASKED} SELECT doc_id, item_id FROM ask, rec WHERE len(list_intersect(q, t)) >= 2 AND len(list_intersect(q, t)) / len(q) >= 0.3")
def s29_exact_records(spark, root):
    return _overlap(spark, root).where("shared >= 2 and shared / asked >= 0.3").select("doc_id", "item_id")


@query(f"WITH {_RECORDS}, {_ASKED} SELECT doc_id, item_id, len(list_intersect(q, t))::INT AS shared, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_intersect(q, t)) DESC, item_id)::INT AS place FROM ask, rec WHERE len(list_intersect(q, t)) >= 1 QUALIFY place <= 4")
def s29_lexical_fallback(spark, root):
    return re_.top(_overlap(spark, root), ["doc_id"], [F.desc("shared"), "item_id"], 4).select("doc_id", "item_id", "shared", "place")


QUERIES["s25_lexical_top_k"] = s29_lexical_fallback
ORACLES["s25_lexical_top_k"] = ORACLES["s29_lexical_fallback"]


@query(f"WITH {_RECORDS}, {_ASKED}, o AS (SELECT doc_id, item_id, len(list_intersect(q, t)) AS shared, len(q) AS n FROM ask, rec WHERE len(list_intersect(q, t)) >= 1), x AS (SELECT doc_id, item_id, shared, (shared >= 2 AND shared / n >= 0.3)::INT AS exact FROM o) SELECT doc_id, item_id, exact, row_number() OVER (PARTITION BY doc_id ORDER BY exact DESC, shared DESC, item_id)::INT AS place FROM x QUALIFY place <= 4")
def s29_hybrid(spark, root):
    o = _overlap(spark, root).withColumn("exact", ((F.col("shared") >= 2) & (F.col("shared") / F.col("asked") >= 0.3)).cast("int"))
    return re_.top(o, ["doc_id"], [F.desc("exact"), F.desc("shared"), "item_id"], 4).select("doc_id", "item_id", "exact", "place")


@query("SELECT issue_id, ingested_at, k.name AS standard FROM issues, LATERAL (SELECT unnest(knowledge_standards) AS k) WHERE category IN ('security', 'privacy') QUALIFY row_number() OVER (PARTITION BY issue_id, ingested_at ORDER BY k.name) <= 3")
def s29_rerank_issue(spark, root):
    i = table(spark, root, "issues").where(F.col("category").isin("security", "privacy")).select("issue_id", "ingested_at", F.explode("knowledge_standards.name").alias("standard"))
    return re_.top(i, ["issue_id", "ingested_at"], ["standard"], 3).select("issue_id", "ingested_at", "standard")


@query("SELECT doc_id FROM documents WHERE lower(lang) IN ('en', 'any') OR lang IS NULL")
def s29_metadata_filter(spark, root):
    return table(spark, root, "documents").where(F.lower("lang").isin("en", "any") | F.col("lang").isNull()).select("doc_id")


_IDS = "list_distinct(list_transform(list_filter(regexp_extract_all(trim(coalesce(evidence, '')), '[a-zA-Z_][a-zA-Z0-9_]{2,}'), lambda w: length(w) >= 5 AND (contains(w, '_') OR regexp_matches(w, '[a-z][A-Z]'))), lambda x: lower(x)))"
_SRC = "list_transform(regexp_extract_all(content, '[a-zA-Z_][a-zA-Z0-9_]{2,}'), lambda x: lower(x))"
_SQZ = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_GROUND = f"""WITH {_FILES}, g AS (SELECT DISTINCT issue_id, i.ingested_at, CASE WHEN line <> 0 AND (line < 1 OR line > greatest(1, len(string_split(regexp_replace(content, '\\r?\\n$', ''), chr(10))))) THEN 'line_out_of_range'
 WHEN trim(coalesce(evidence, '')) = '' AND source = 'ai_quality' THEN 'no_evidence' WHEN trim(coalesce(evidence, '')) = '' THEN NULL WHEN contains({_SQZ.format('content')}, {_SQZ.format("trim(coalesce(evidence, ''))")}) THEN NULL
 WHEN len(list_filter({_IDS}, lambda w: NOT list_contains({_SRC}, w))) > 0 THEN 'unknown_identifier' END AS reason FROM issues i JOIN f ON f.project_id = i.project_id AND f.path = i.file WHERE content <> '')"""


def _grounded(spark, root):
    i = table(spark, root, "issues").select("issue_id", "ingested_at", "project_id", F.col("file").alias("path"), "line", "evidence", "source")
    return i.join(files(spark, root).select("project_id", "path", "content").where("content <> ''"), ["project_id", "path"]).select("issue_id", "ingested_at", text.grounding(F.col("content"), F.col("line"), F.col("evidence"), F.col("source")).alias("reason")).distinct()


@query(_GROUND + "SELECT * FROM g")
def s210_grounding(spark, root):
    return _grounded(spark, root)


@query(_GROUND + "SELECT coalesce(reason, 'grounded') AS bucket, count(*) AS n FROM g GROUP BY 1")
def s210_rejection_reasons(spark, root):
    return _grounded(spark, root).groupBy(F.coalesce("reason", F.lit("grounded")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT DISTINCT issue_id, len(list_filter({_IDS}, lambda w: NOT list_contains({_SRC}, w)))::INT AS unknown FROM issues i JOIN f ON f.project_id = i.project_id AND f.path = i.file WHERE content <> ''")
def s23_unknown_identifiers(spark, root):
    i = table(spark, root, "issues").select("issue_id", "project_id", F.col("file").alias("path"), "evidence")
    j = i.join(files(spark, root).select("project_id", "path", "content").where("content <> ''"), ["project_id", "path"])
    return j.select("issue_id", F.size(F.array_except(text.identifiers(F.trim(F.coalesce("evidence", F.lit("")))), text.tokens(F.col("content")))).alias("unknown")).distinct()


@query(f"WITH {_FILES} SELECT DISTINCT i.issue_id FROM issues i WHERE EXISTS (SELECT 1 FROM f WHERE f.project_id = i.project_id AND f.path = i.file)")
def s23_cited_files(spark, root):
    return table(spark, root, "issues").select("issue_id", "project_id", F.col("file").alias("path")).join(files(spark, root).select("project_id", "path"), ["project_id", "path"], "left_semi").select("issue_id").distinct()


@query("SELECT a.issue_id FROM issues a WHERE category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM projects p WHERE p.project_id = a.project_id AND (list_contains(p.languages, 'python') OR p.languages IS NULL))")
def s23_language_mismatch(spark, root):
    p = table(spark, root, "projects").where(F.array_contains("languages", "python") | F.col("languages").isNull()).select("project_id")
    return table(spark, root, "issues").where("category is not null").join(p, "project_id", "left_anti").select("issue_id")


@query("WITH std(dimension, language) AS (VALUES ('security', 'any'), ('code_quality', 'python,java'), ('performance', 'python'), ('testing', 'any')), d AS (SELECT DISTINCT project_id, unnest(languages) AS language FROM projects) SELECT project_id, d.language, dimension FROM d JOIN std ON std.language = 'any' OR list_contains(string_split(std.language, ','), d.language)")
def s23_standards_theta(spark, root):
    rows = [("security", ["any"]), ("code_quality", ["python", "java"]), ("performance", ["python"]), ("testing", ["any"])]
    std = F.array(*[F.struct(F.lit(d).alias("dimension"), F.array(*map(F.lit, ls)).alias("ls")) for d, ls in rows])
    d = table(spark, root, "projects").select("project_id", F.explode("languages").alias("language")).distinct()
    return d.select("*", F.inline(std)).where(F.array_contains("ls", "any") | F.array_contains("ls", F.col("language"))).select("project_id", "language", "dimension")
