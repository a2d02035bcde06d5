"""One record for every finding, those with one id or without any usable value too."""

from datetime import datetime

from __spark_entry__ import queries

SCHEMA = "issue_id bigint, finding_id string, severity string, confidence double, fix_suggestion string, evidence string, source string, created_at timestamp_ntz"


def test_every_finding_gets_a_record(spark, tmp_path):
    at = datetime(2025, 1, 1)
    rows = [
        (1, "A ", "high", 0.5, "fix it", "x()", "cli", at), (2, "a", "low", None, None, None, "deterministic", at),
        (3, "one", "Low", 0.25, "n/a", "y()", "cli", at), (4, "none", "?", -1.0, "", "-", "cli", None), (4, "none", "?", -1.0, "", "-", "cli", None),
        (None, "no id", "high", 0.5, "fix it", "x()", "cli", at), (5, " ", "high", 0.5, "fix it", "x()", "cli", at),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/issues.parquet")
    spark.createDataFrame([("deterministic", 1)], "source string, trust_rank int").write.parquet(f"{tmp_path}/source_trust.parquet")
    got = {r["finding_id"]: (r["severity"], r["severity_issue_id"], r["confidence"], r["evidence_issue_id"]) for r in queries()["p2_records"](spark, str(tmp_path)).collect()}
    assert got == {"a": ("low", 2, "0.5", 1), "one": ("Low", 3, "0.25", 3), "none": (None, None, None, None)}
    assert {r["finding_id"] for r in queries()["p2_found"](spark, str(tmp_path)).collect()} == {"a"}
