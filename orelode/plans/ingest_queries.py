"""Queries on files, paths and tables of projects, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions import paths
from orelode.sources import archives
from orelode.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "files").select(*columns)


_PARTS = "list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p <> '' AND p <> '.')"
_BASE = f"list_extract({_PARTS}, -1)"
_LANG = "CASE lower(regexp_extract(path, '\\.[^./]*$')) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.hpp' THEN 'cpp' ELSE 'other' END"
_IGN = "('.git', 'node_modules', 'venv', '.venv', '__pycache__', 'dist', 'build', 'coverage', '.cache')"
_CONFIG = "('requirements.txt', 'pyproject.toml', 'package.json', 'setup.py', 'pom.xml', 'build.gradle', '.env.example', 'tsconfig.json')"
_DEPLOY = "('Dockerfile', 'docker-compose.yml', 'docker-compose.yaml', 'render.yaml', 'vercel.json', 'Procfile')"
_TEST = f"(list_has_any({_PARTS}, ['tests', '__tests__']) OR regexp_matches({_BASE}, '^(test_.*\\.py|.*_test\\.py|.*\\.(test|spec)\\.(js|jsx|ts|tsx))$'))"


@query(f"SELECT file_id, {_LANG} AS guessed FROM files")
def s21_language(spark, root):
    return files(spark, root, "file_id", "path").select("file_id", paths.language(F.col("path")).alias("guessed"))


@query(f"SELECT file_id, ({_LANG} <> 'other' OR {_BASE} IN {_CONFIG} OR {_BASE} IN {_DEPLOY}) AS as_text FROM files")
def s21_text_or_binary(spark, root):
    p = F.col("path")
    return files(spark, root, "file_id", "path").select("file_id", paths.read_as_text(p, paths.language(p)).alias("as_text"))


@query("SELECT project_id AS archive, count(*) AS entries, sum(size)::BIGINT AS total_size, CASE WHEN count(*) > 2000 THEN 'too many entries' WHEN max(size) > 15728640 THEN 'file too large' WHEN sum(size) > 629145600 THEN 'too large in all' WHEN count(*) > count(DISTINCT path) THEN 'duplicate path' END AS reason FROM files GROUP BY 1")
def s21_admission(spark, root):
    return archives.admission(files(spark, root, F.col("project_id").alias("archive"), F.col("path").alias("name"), "size"))


@query("SELECT file_id, list_contains(string_split(replace(p, '\\', '/'), '/'), '..') OR starts_with(replace(p, '\\', '/'), '/') OR regexp_matches(p, '^.:') OR len(list_filter(string_split(replace(p, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.')) > 20 AS unsafe FROM (SELECT file_id, CASE file_id % 5 WHEN 0 THEN '../' || path WHEN 1 THEN '/' || path WHEN 2 THEN 'C:\\' || path WHEN 3 THEN repeat('a/', 20) || path ELSE path END AS p FROM files)")
def s21_unsafe_paths(spark, root):
    k = F.col("file_id") % 5
    p = F.when(k == 0, F.concat(F.lit("../"), "path")).when(k == 1, F.concat(F.lit("/"), "path")).when(k == 2, F.concat(F.lit("C:\\"), "path")).when(k == 3, F.concat(F.repeat(F.lit("a/"), 20), "path")).otherwise(F.col("path"))
    return files(spark, root, "file_id", "path").select("file_id", paths.unsafe(p).alias("unsafe"))


@query("SELECT project_id, path AS canonical_path, count(*) AS copies FROM files GROUP BY 1, 2 HAVING count(*) > 1")
def s21_duplicate_paths(spark, root):
    return archives.duplicate_paths(files(spark, root, "project_id", "path"), "project_id", "path")


@query(f"SELECT project_id, d AS ignored_dir, count(*) AS files FROM (SELECT project_id, list_extract(list_filter({_PARTS}, lambda p: p IN {_IGN}), 1) AS d FROM files) WHERE d IS NOT NULL GROUP BY 1, 2")
def s21_ignored_dirs(spark, root):
    return archives.ignored_counts(files(spark, root, "project_id", "path"), "project_id", "path")


@query("SELECT project_id, CASE WHEN count(DISTINCT t) = 1 THEN max(t) || '/' ELSE '' END AS prefix FROM (SELECT project_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS t FROM files) GROUP BY 1")
def s21_common_prefix(spark, root):
    return archives.common_top(files(spark, root, "project_id", "path"), "project_id", "path")


@query("SELECT project_id, 'someone/' || name AS repository FROM projects WHERE regexp_matches(name, '^[A-Za-z0-9_.-]+$')")
def s21_repository(spark, root):
    address = F.when(F.crc32("project_id") % 2 == 0, F.concat(F.lit("https://github.com/someone/"), "name", F.lit(".git"))).otherwise(F.concat(F.lit("someone/"), "name"))
    return table(spark, root, "projects").select("project_id", archives.repository(address).alias("repository")).where("repository is not null")


@query("""
WITH f AS (SELECT project_id, path, file_ord, content FROM files),
r AS (SELECT project_id, path AS source, file_ord, u.i AS place, trim(split_part(u.l, '#', 1)) AS line FROM f, LATERAL (SELECT unnest(string_split_regex(content, '\\r\\n|\\r|\\n')) AS l, generate_subscripts(string_split_regex(content, '\\r\\n|\\r|\\n'), 1) AS i) u WHERE regexp_extract(path, '[^/]*$') = 'requirements.txt'),
a AS (SELECT project_id, regexp_extract(line, '^([A-Za-z0-9_.-]+)', 1) AS name, trim(regexp_extract(line, '^[A-Za-z0-9_.-]+\\s*([<>=!~].*)?$', 1)) AS version, source, file_ord, place FROM r
  WHERE line <> '' AND NOT starts_with(line, '-r ') AND NOT starts_with(line, '--') AND regexp_matches(line, '^[A-Za-z0-9_.-]+\\s*([<>=!~].*)?$')),
p AS (SELECT project_id, path, file_ord, s.n, s.k, TRY(CAST(content AS JSON)) -> s.n AS d FROM f, (VALUES ('dependencies', 0), ('devDependencies', 1), ('peerDependencies', 2), ('optionalDependencies', 3)) s(n, k) WHERE regexp_extract(path, '[^/]*$') = 'package.json' AND json_valid(content)),
b AS (SELECT project_id, u.key AS name, d ->> u.key AS version, path || ':' || n AS source, file_ord, k * 1000000 AS place FROM p, LATERAL (SELECT unnest(json_keys(d)) AS key) u WHERE json_type(d) = 'OBJECT')
SELECT project_id, name, version, source FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY project_id, lower(name), source ORDER BY file_ord, place) = 1
""")
def s21_dependencies(spark, root):
    return archives.dependencies(files(spark, root, "project_id", "path", "file_ord", "content"))


@query(f"SELECT project_id, array_to_string(l, ',') AS languages, files, CASE len(l) WHEN 0 THEN 'unknown' WHEN 1 THEN 'single-language' ELSE 'multi-language' END AS project_type FROM (SELECT project_id, coalesce(list_sort(list(DISTINCT g) FILTER (g <> 'other')), []) AS l, count(*) AS files FROM (SELECT project_id, {_LANG} AS g FROM files) GROUP BY 1)")
def s21_project_metadata(spark, root):
    return archives.project_metadata(files(spark, root, "project_id", "path")).withColumn("languages", F.array_join("languages", ","))


@query(f"SELECT DISTINCT project_id, array_to_string(p[1:n], '/') AS directory FROM (SELECT project_id, {_PARTS} AS p FROM files), LATERAL (SELECT unnest(range(1, len(p))) AS n)")
def s21_directories(spark, root):
    return archives.directories(files(spark, root, "project_id", "path"))


@query("SELECT file_id, length(content) > 100000 AS large FROM files WHERE content IS NOT NULL")
def s21_large_files(spark, root):
    return files(spark, root, "file_id", "content").where("content is not null").select("file_id", (F.length("content") > paths.LARGE_CHARS).alias("large"))


@query("SELECT sha256(content) AS content_ref, min(length(content))::BIGINT AS n_chars, count(*) AS held_by FROM files WHERE content IS NOT NULL GROUP BY 1")
def s21_content_store(spark, root):
    held, blobs = archives.content_store(files(spark, root, "file_id", "content"))
    return blobs.join(held.groupBy("content_ref").agg(F.count("*").alias("held_by")), "content_ref").select("content_ref", F.length("content").cast("bigint").alias("n_chars"), "held_by")


@query("SELECT file_id, md5(content) AS content_md5 FROM files")
def s21_hydrated(spark, root):
    held, blobs = archives.content_store(files(spark, root, "file_id", "content"))
    return archives.hydrate(held, blobs).select("file_id", F.md5("content").alias("content_md5"))


@query("SELECT file_id, project_id, path, language, size FROM files")
def s21_metadata_without_bodies(spark, root):
    return files(spark, root, "file_id", "project_id", "path", "language", "size")


@query("SELECT project_id, path, min(file_ord) AS file_ord FROM files WHERE regexp_matches(path, '(^|/)Dockerfile$') GROUP BY 1, 2")
def s21_point_read(spark, root):
    return files(spark, root, "project_id", "path", "file_ord").where(paths.base_name(F.col("path")) == "Dockerfile").groupBy("project_id", "path").agg(F.min("file_ord").alias("file_ord"))


@query("SELECT project_id, source_revision + CASE WHEN owner_user_id IS NOT NULL AND source_revision % 2 = 0 THEN 1 ELSE 0 END AS source_revision, owner_user_id IS NOT NULL AND source_revision % 2 = 0 AS committed FROM projects")
def s21_update_project(spark, root):
    p = table(spark, root, "projects")
    stale = F.when(F.col("source_revision") % 2 == 0, F.col("source_revision")).otherwise(F.col("source_revision") - 1)
    changes = p.select("project_id", stale.alias("expected"), F.coalesce("owner_user_id", F.lit("nobody")).alias("owner_user_id"))
    return archives.update_where(p, changes, "project_id", "expected", "source_revision").select("project_id", "source_revision", "committed")


@query("SELECT issue_id, CASE WHEN issue_id % 7 = 0 THEN 'closed' ELSE severity END AS severity, count(*) AS n FROM issues GROUP BY 1, 2")
def s21_update_findings(spark, root):
    i = table(spark, root, "issues")
    changes = i.where("issue_id % 7 = 0").select("issue_id", F.lit("closed").alias("new")).dropDuplicates(["issue_id"])
    return i.join(changes, "issue_id", "left").select("issue_id", F.coalesce("new", "severity").alias("severity")).groupBy("issue_id", "severity").agg(F.count("*").alias("n"))


@query("SELECT file_id FROM files WHERE split_part(path, '/', 1) NOT IN " + _IGN + " AND NOT regexp_matches(path, '(\\.env|\\.pyc)$')")
def s21_fixed_archive_entries(spark, root):
    return archives.exportable(files(spark, root, "file_id", "path")).select("file_id")


@query("SELECT (SELECT count(*) FROM projects WHERE source_revision % 3 = 0) AS matched, 0::BIGINT AS upserted, (SELECT count(*) FROM projects WHERE name LIKE 'new-%') + (SELECT count(*) FROM projects WHERE source_revision % 3 = 0) AS renamed")
def s21_upsert(spark, root):
    p = table(spark, root, "projects").select("project_id", "name", "created_at", "source_revision")
    new = p.where("source_revision % 3 = 0").select("project_id", F.concat(F.lit("new-"), "name").alias("name"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"), "source_revision")
    after, counts = archives.upsert(p, new, ["project_id"])
    kept = after.join(p.select("project_id", F.col("created_at").alias("was")), "project_id").where(F.col("created_at").eqNullSafe(F.col("was")) & F.col("name").startswith("new-"))
    return counts.crossJoin(kept.agg(F.count("*").alias("renamed"))).select("matched", "upserted", "renamed")


@query("SELECT project_id, md5(string_agg('# ' || path || chr(10) || substr(coalesce(content, ''), 1, 2000), chr(10) ORDER BY file_ord)) AS text_md5 FROM files GROUP BY 1")
def s21_embedding_text(spark, root):
    return archives.embedding_text(files(spark, root, "project_id", "file_ord", "path", "content")).select("project_id", F.md5("text").alias("text_md5"))


@query("SELECT owner_user_id, project_id FROM projects WHERE owner_user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner_user_id ORDER BY created_at DESC NULLS LAST, project_id) <= 20")
def s21_review_history(spark, root):
    from orelode.operators.retrieval import top
    return top(table(spark, root, "projects").where("owner_user_id is not null").select("owner_user_id", "project_id", "created_at"), ["owner_user_id"], [F.desc_nulls_last("created_at"), "project_id"], 20).select("owner_user_id", "project_id")


@query(f"SELECT file_id, {_TEST} AS is_test FROM files")
def s22_test_files(spark, root):
    return files(spark, root, "file_id", "path").select("file_id", paths.is_test(F.col("path")).alias("is_test"))


@query(f"SELECT file_id FROM files WHERE {_BASE} IN {_CONFIG}")
def s22_config_files(spark, root):
    return files(spark, root, "file_id", "path").where(paths.is_config(F.col("path"))).select("file_id")


@query(f"SELECT file_id FROM files WHERE {_BASE} IN {_DEPLOY} OR contains(path, '.github/workflows/')")
def s22_deployment_files(spark, root):
    return files(spark, root, "file_id", "path").where(paths.is_deployment(F.col("path"))).select("file_id")


@query("SELECT f.file_id FROM files f JOIN projects p USING (project_id) WHERE p.owner_user_id = 'usr-38'")
def s22_owner_scoped(spark, root):
    mine = table(spark, root, "projects").where("owner_user_id = 'usr-38'").select("project_id")
    return files(spark, root, "file_id", "project_id").join(mine, "project_id", "left_semi").select("file_id")


@query("SELECT project_id, finding_id, min(issue_id) AS issue_id FROM issues WHERE finding_id <> '' GROUP BY 1, 2")
def s22_finding_lookup(spark, root):
    return table(spark, root, "issues").where("finding_id <> ''").groupBy("project_id", "finding_id").agg(F.min("issue_id").alias("issue_id"))


@query("SELECT issue_id, ingested_at FROM issues WHERE NOT coalesce(category = 'best_practice' AND severity = 'low' AND confidence < 0.6, false)")
def s22_style_noise(spark, root):
    noise = F.coalesce((F.col("category") == "best_practice") & (F.col("severity") == "low") & (F.col("confidence") < 0.6), F.lit(False))
    return table(spark, root, "issues").where(~noise).select("issue_id", "ingested_at")


@query("SELECT issue_id, ingested_at FROM issues WHERE file <> '' AND line > 0")
def s22_real_place(spark, root):
    from orelode.operators.findings import has_place
    return table(spark, root, "issues").where(has_place(F.col("file"), F.col("line"))).select("issue_id", "ingested_at")


@query(f"SELECT project_id, file_id FROM (SELECT *, {_LANG} AS g FROM files) WHERE g <> 'other' AND content <> '' AND NOT {_TEST} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY length(content) DESC, file_ord, file_id) <= 40")
def s22_eligible_files(spark, root):
    from orelode.operators.retrieval import top
    f = files(spark, root, "project_id", "file_id", "file_ord", "path", "content").where((paths.language(F.col("path")) != "other") & (F.col("content") != "") & ~paths.is_test(F.col("path")))
    return top(f.select("project_id", "file_id", "file_ord", F.length("content").alias("n")), ["project_id"], [F.desc("n"), "file_ord", "file_id"], 40).select("project_id", "file_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'production|ready|readiness|secure|security|vulnerab|scale|scalab|architecture|database|deploy|deployment|improve|improvement|best practice|reliab|performance|risky|risk')")
def s22_guidance(spark, root):
    from orelode.functions.text import asks_for_guidance
    return table(spark, root, "documents").where(asks_for_guidance(F.col("text"))).select("doc_id")


@query("SELECT issue_id, ingested_at FROM issues WHERE severity IN ('critical', 'high') AND category IN ('security', 'privacy') AND contains(lower(file), 'server')")
def s22_filter_by_sets(spark, root):
    return table(spark, root, "issues").where(F.col("severity").isin("critical", "high") & F.col("category").isin("security", "privacy") & F.lower("file").contains("server")).select("issue_id", "ingested_at")


@query("SELECT issue_id, ingested_at FROM issues WHERE severity = 'high' AND (contains(lower(coalesce(issue, '')), 'tariff') OR contains(lower(coalesce(file, '')), 'tariff'))")
def s22_filter_by_text(spark, root):
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("tariff")
    return table(spark, root, "issues").where((F.col("severity") == "high") & (has("issue") | has("file"))).select("issue_id", "ingested_at")


@query("SELECT file_id, CASE WHEN regexp_matches(lower(path), 'route|api|controller|handler') THEN 'routes' WHEN regexp_matches(lower(path), 'service|logic|manager|client') THEN 'services' WHEN regexp_matches(lower(path), 'repo|db|database|query|store') THEN 'database' ELSE 'modules' END AS layer FROM files")
def s22_layers(spark, root):
    return files(spark, root, "file_id", "path").select("file_id", paths.layer(F.col("path")).alias("layer"))


@query("SELECT issue_id, ingested_at, k.name AS standard, k.reference FROM issues, LATERAL (SELECT unnest(knowledge_standards) AS k)")
def s22_standards_projected(spark, root):
    return table(spark, root, "issues").select("issue_id", "ingested_at", F.explode("knowledge_standards").alias("k")).select("issue_id", "ingested_at", F.col("k.name").alias("standard"), F.col("k.reference").alias("reference"))


QUERIES, ORACLES = Q, SQL
