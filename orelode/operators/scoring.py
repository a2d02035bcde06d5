"""Scores of projects from their findings and files, one row per project and dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions import paths
from orelode.operators.findings import looked_up

# Dimensions with weights, deductions, dimension of each category, words that decide about heuristics.
WEIGHTS = {"security": 0.20, "code_quality": 0.20, "architecture": 0.15, "testing": 0.15, "api_design": 0.10, "performance": 0.10, "production_readiness": 0.10}
DEDUCTION, OTHER_DEDUCTION = {"critical": 25, "high": 15, "medium": 8, "low": 3}, 3
DIMENSION = {
    "security": "security", "privacy": "security", "best_practice": "code_quality", "correctness": "code_quality", "logic": "code_quality", "database": "code_quality", "data_integrity": "code_quality",
    "maintainability": "code_quality", "architecture": "architecture", "reliability": "architecture", "testing": "testing", "api_design": "api_design", "performance": "performance",
    "production_readiness": "production_readiness",
}
STANDARD = {
    "hardcoded_secret": "SEC-01", "sql_concat": "SEC-02", "dangerous_eval": "SEC-03", "subprocess_shell_true": "SEC-04", "tls_verification_disabled": "SEC-05", "unsafe_deserialization": "SEC-06",
    "empty_exception_handler": "CQ-01", "todo_marker": "CQ-02", "route_without_related_validation": "API-01", "large_route_handler": "ARCH-01", "possible_blocking_work": "PERF-01",
}
VALIDATION_WORDS = ("pydantic", "joi", "zod", "express-validator", "validate")
BLOCKING_WORDS = ("execsync", "readfilesync", "writefilesync", "sleep(", "time.sleep", "image.resize", "sharp(")
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def deduction(severity: Column) -> Column:
    return looked_up(DEDUCTION, severity, F.lit(OTHER_DEDUCTION))


def category_scores(findings: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, dimension, score, finding_count) from findings alone; categories without a dimension do not count."""
    dimension = looked_up(DIMENSION, F.col("category"))
    return findings.select(key, dimension.alias("dimension"), deduction(F.col("severity")).alias("d")).where("dimension is not null").groupBy(key, "dimension").agg(
        F.greatest(F.lit(0), 100 - F.sum("d")).cast("int").alias("score"), F.count("*").cast("int").alias("finding_count"))


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def project_facts(files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One row per project with what the heuristics ask: counts and flags, taken in one pass of partial aggregation."""
    path = F.col("path")
    facts = files.groupBy("project_id").agg(
        F.count("*").alias("files"), F.bool_or(F.array_contains(F.split(paths.slashed(path), "/"), "services")).alias("service_layer"), F.bool_or(paths.is_test(path)).alias("tests"),
        F.bool_or(paths.is_config(path)).alias("configs"), F.bool_or(paths.is_deployment(path)).alias("deployment"), F.bool_or(_any_word(F.col("content"), VALIDATION_WORDS)).alias("validation"),
        F.bool_or(_any_word(F.col("content"), BLOCKING_WORDS)).alias("blocking"))
    return facts.join(endpoints.groupBy("project_id").agg(F.count("*").alias("endpoints")), "project_id", "left").withColumn("endpoints", F.coalesce("endpoints", F.lit(0)))


def score(projects: DataFrame, facts: DataFrame, findings: DataFrame, partial: Column | None = None) -> DataFrame:
    """(project_id, dimension, score, status, weight, finding_count): seven rows per project; the score is null where nothing was evaluated.

    ``partial``: a condition on the facts under which a review covered only some files. Projects without files get rows too.
    """
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight")) for d, w in WEIGHTS.items()])
    base = projects.select("project_id").distinct().join(facts, "project_id", "left").withColumn("partial", partial if partial is not None else F.lit(False)).select("*", F.inline(dims))
    s = base.join(category_scores(findings).withColumnRenamed("score", "found"), ["project_id", "dimension"], "left")
    found, count = F.coalesce("found", F.lit(100)), F.coalesce("finding_count", F.lit(0))
    has = lambda name: F.coalesce(F.col(name), F.lit(False))
    d, files, ends = F.col("dimension"), F.coalesce("files", F.lit(0)), F.coalesce("endpoints", F.lit(0))
    flag = lambda c: c.cast("int")
    arch = flag((ends >= 5) & ~has("service_layer"))
    api, slow, test = flag((ends > 0) & ~has("validation")), flag(has("blocking")), flag((files > 0) & ~has("tests"))
    ship, manifest = flag(~has("deployment")), flag(~has("configs"))
    raw = (
        F.when(d.isin("security", "code_quality"), found).when(d == "architecture", found - 15 * arch).when(d == "api_design", F.least(100 - 20 * api, found))
        .when(d == "performance", F.least(100 - 10 * slow, found)).when(d == "testing", 100 - 40 * test).otherwise(found - 20 * ship - 10 * manifest)
    )
    extra = (
        F.when(d == "architecture", arch).when(d == "api_design", api).when(d == "performance", slow).when(d == "testing", test).when(d == "production_readiness", ship + manifest).otherwise(0)
    )
    status = (
        F.when(d == "api_design", F.when(ends == 0, "not_evaluated").when(F.col("partial"), "partial").otherwise("evaluated"))
        .when(files == 0, "not_evaluated").when(d.isin("performance", "testing"), "evaluated").when(F.col("partial"), "partial").otherwise("evaluated")
    )
    counted = F.when(d == "testing", F.lit(0)).when((d == "api_design") & (ends == 0), F.lit(0)).otherwise(count)
    out = s.select("project_id", "dimension", "weight", status.alias("status"), raw.alias("raw"), (counted + extra).cast("int").alias("finding_count"))
    return out.select("project_id", "dimension", F.when(F.col("status") != "not_evaluated", F.greatest(F.lit(0), F.least(F.lit(100), "raw"))).cast("int").alias("score"), "status", "weight", "finding_count")


def overall(scores: DataFrame) -> DataFrame:
    """(project_id, overall_score, dimensions_evaluated): weighted mean over what was evaluated, to one place, halves up; null if nothing was.

    Weights count in hundredths, so that the mean is one division of whole numbers and the rounding is exact.
    """
    w = F.round(F.col("weight") * 100).cast("bigint")
    r = scores.groupBy("project_id").agg(F.sum(F.col("score") * w).alias("n"), F.sum(F.when(F.col("score").isNotNull(), w)).alias("d"), F.count("score").cast("int").alias("dimensions_evaluated"))
    return r.select("project_id", (F.floor((20 * F.col("n") + F.col("d")) / (2 * F.col("d"))) / 10).alias("overall_score"), "dimensions_evaluated")


def file_risk(findings: DataFrame) -> DataFrame:
    """(project_id, file, risk): sum of severity weights; findings without a file do not count."""
    return findings.where("file is not null and file <> ''").groupBy("project_id", "file").agg(F.sum(looked_up(SEVERITY_WEIGHT, F.col("severity"), F.lit(0))).cast("int").alias("risk"))


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in DEDUCTION])


def quality(labelled: DataFrame, said: Column, true: Column) -> DataFrame:
    """One row: counts, precision, recall, F1, false-positive and false-negative rate; 0 where a denominator is 0."""
    r = labelled.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, q = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return r.select("*", p.alias("precision"), q.alias("recall"), ratio(2 * p * q, p + q).alias("f1"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), ratio(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))
