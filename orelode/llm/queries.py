"""Queries and SQL of the operators on training data, one group for each problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm import bisection, credentials, leakage, packing, provenance, quality, survivorship, validity
from orelode.sources.tables import budget, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return validity.check_files(table(spark, root, "files")).where("not valid").select("file_id")


def p1_files(spark: SparkSession, root: str) -> DataFrame:
    return validity.check_files(table(spark, root, "files"))


def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    return validity.rates(validity.check_files(table(spark, root, "files")))


def _trust(spark: SparkSession, root: str) -> dict[str, int]:
    return survivorship.trust_of(table(spark, root, "source_trust"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return survivorship.survivors(table(spark, root, "issues"), _trust(spark, root))


def p2_records(spark: SparkSession, root: str) -> DataFrame:
    return survivorship.strict_records(table(spark, root, "issues"), _trust(spark, root))


def p2_truth(spark: SparkSession, root: str) -> DataFrame:
    return survivorship.discover_truth(table(spark, root, "issues"), _trust(spark, root))[0]


def p2_reliabilities(spark: SparkSession, root: str) -> DataFrame:
    return survivorship.discover_truth(table(spark, root, "issues"), _trust(spark, root))[1]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return provenance.find_unwritten(table(spark, root, "files"), table(spark, root, "third_party")).where("unwritten").select("file_id")


def p3_scores(spark: SparkSession, root: str) -> DataFrame:
    return provenance.find_unwritten(table(spark, root, "files"), table(spark, root, "third_party"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return (
        bisection.split_oversized(table(spark, root, "files"), *budget(spark, root, "review_chunk"), bodies=False)
        .where("piece_no = 0").select("file_id", "start_line")
    )


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    return bisection.split_oversized(table(spark, root, "files"), *budget(spark, root, "review_chunk"))


def p4_small_pieces(spark: SparkSession, root: str) -> DataFrame:
    return bisection.split_oversized(table(spark, root, "files"), *budget(spark, root, "small_chunk"))


def p4_files_whole(spark: SparkSession, root: str) -> DataFrame:
    """Per oversized file: its length, the longest piece over the capacity (0 if none), and whether its pieces give the content again."""
    files = table(spark, root, "files")
    capacity, overlap = budget(spark, root, "review_chunk")
    pieces = bisection.split_oversized(files, capacity, overlap).where("start_line = 0")
    parts = pieces.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("core")))).alias("parts"), F.count_if(F.col("n_chars") > capacity).alias("too_long"),
    )
    return parts.select("file_id", F.length(F.array_join("parts.core", "")).cast("bigint").alias("n_chars"), "too_long", F.md5(F.array_join("parts.core", "")).alias("content_md5"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return credentials.find_credentials(table(spark, root, "files"))


def p5_redacted(spark: SparkSession, root: str) -> DataFrame:
    return credentials.redact(table(spark, root, "files"))


def p6_pack_512(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_texts(table(spark, root, "documents"), budget(spark, root, "pack_512")[0])


def p6_pack_2048(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_texts(table(spark, root, "documents"), budget(spark, root, "pack_2048")[0])


def p6_pack_4096(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_texts(table(spark, root, "documents"), budget(spark, root, "pack_4096")[0])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return quality.text_statistics(table(spark, root, "documents")).where("lines > 0 and not is_prose").select("doc_id")


def p8_statistics(spark: SparkSession, root: str) -> DataFrame:
    return quality.text_statistics(table(spark, root, "documents"))


QUERIES = {
    f.__name__: f for f in (
        p1_found, p1_files, p1_rates, p2_found, p2_records, p2_truth, p2_reliabilities, p3_found, p3_scores, p4_found, p4_pieces, p4_small_pieces, p4_files_whole, p5_found, p5_redacted,
        p6_pack_512, p6_pack_2048, p6_pack_4096, p7_found, p8_found, p8_statistics,
    )
}

# Stand-ins for nothing, stated here again so that the SQL is no echo of the operator.
_NOTHING = """'', 'n/a', 'na', 'n.a', 'none', 'null', 'nil', 'nan', 'undefined', 'unknown', 'tbd', 'tba', 'todo', 'not available', 'not applicable', 'no suggestion',
 'no specific suggestion available', 'no evidence', 'missing', 'empty', 'pending', 'to be done', 'to be determined', 'not set', 'unset', 'no data', 'no value', 'xxx'"""
_TEXT = "regexp_matches({0}, '[\\p{{L}}\\p{{N}}]') AND regexp_replace(regexp_replace(lower(trim({0}, E' \\t\\r\\n')), '^[<\\[({{\\s]+', ''), '[>\\])}}.\\s]+$', '') NOT IN (" + _NOTHING + ")"
_CLAIMS = """
WITH t AS (SELECT array_to_string(list_sort(string_split(lower(source), '+')), '+') AS s, min(trust_rank) AS r FROM source_trust GROUP BY 1),
i AS (SELECT lower(trim(finding_id)) AS finding_id, issue_id, severity, confidence, fix_suggestion, evidence, created_at,
  array_to_string(list_sort(list_distinct(list_transform(string_split(lower(trim(source)), '+'), lambda p: regexp_replace(trim(p), '[\\s\\-_]+', '_', 'g')))), '+') AS s
  FROM issues WHERE trim(finding_id) <> '' AND issue_id IS NOT NULL),
g AS (SELECT finding_id FROM i GROUP BY 1 HAVING count(DISTINCT issue_id) > 1),
c AS (SELECT finding_id, issue_id, coalesce(r, 1073741824) AS r, created_at, f.field_name, f.value, f.usable FROM i LEFT JOIN t USING (s),
  LATERAL (VALUES ('severity', severity, lower(trim(severity)) IN ('critical', 'high', 'medium', 'low')),
    ('confidence', CAST(confidence AS VARCHAR), confidence BETWEEN 0 AND 1), ('fix_suggestion', fix_suggestion, %s), ('evidence', evidence, %s)) AS f(field_name, value, usable)),
b AS (SELECT * FROM c WHERE usable QUALIFY row_number() OVER (PARTITION BY finding_id, field_name ORDER BY r, created_at DESC NULLS LAST, issue_id) = 1)
""" % (_TEXT.format("fix_suggestion"), _TEXT.format("evidence"))
_FIELDS = ("severity", "confidence", "fix_suggestion", "evidence")
ORACLES = {
    "p2_found": _CLAIMS + "SELECT finding_id, field_name, issue_id FROM b WHERE finding_id IN (SELECT finding_id FROM g)",
    "p2_records": _CLAIMS + "SELECT k.finding_id, " + ", ".join(f"trim(max(CASE WHEN field_name = '{f}' THEN value END)) AS {f}, max(CASE WHEN field_name = '{f}' THEN issue_id END) AS {f}_issue_id" for f in _FIELDS)
    + " FROM (SELECT DISTINCT finding_id FROM i) k LEFT JOIN b ON b.finding_id = k.finding_id GROUP BY 1",
    "p4_files_whole": "SELECT file_id, length(content) AS n_chars, 0::BIGINT AS too_long, md5(content) AS content_md5 FROM files WHERE length(content) > (SELECT capacity FROM budgets WHERE budget_name = 'review_chunk')",
}
