"""Against brute force on a small fixture with nulls, ties, replays and a hot group."""

import random
from datetime import datetime, timedelta

from orelode.llm import survivorship as s

SCHEMA = (
    "issue_id bigint, finding_id string, severity string, confidence double, fix_suggestion string, evidence string, "
    "source string, created_at timestamp_ntz, _group string"
)
TRUST = {"deterministic": 1, "ai_quality+deterministic": 2, "human_review": 3}


def made(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        f = "HOT" if r.random() < 0.35 else f" f{r.randrange(60)} "
        rows.append((
            r.choice([i, i, None]) if i % 50 == 0 else i, r.choice([f, f.lower(), f"{f} "]) if i % 40 else None,
            r.choice(["High", " low", "n/a", None, "?", "medium"]), r.choice([0.0, 1.0, 0.5, -1.0, float("nan"), float("inf"), None]),
            r.choice(["fix it", "N/A", "", None, "<none>", "..."]), r.choice(["x()", "-", "null", " y() "]),
            r.choice(["Deterministic", "deterministic + AI-Quality", "human review", "cli", None, ""]),
            r.choice([None, datetime(2025, 1, 1) + timedelta(days=r.randrange(4))]), "clash",
        ))
    return rows + rows[:30]


def brute(rows):
    nothing = {"", "n/a", "?", "-", "null", "<none>", "..."}
    name = {"deterministic": 1, "deterministic + ai-quality": 2, "human review": 3}
    ok = (
        lambda v: v is not None and v.strip().lower() in ("critical", "high", "medium", "low"),
        lambda v: v is not None and 0 <= v <= 1,
        *[lambda v: v is not None and v.strip().lower() not in nothing] * 2,
    )
    groups = {}
    for x in rows:
        if x[0] is not None and x[1] and x[1].strip():
            groups.setdefault(x[1].strip().lower(), []).append(x)
    out = set()
    for g, xs in groups.items():
        if len({x[0] for x in xs}) > 1:
            for k, field in enumerate(("severity", "confidence", "fix_suggestion", "evidence")):
                use = [x for x in xs if ok[k](x[2 + k])]
                if use:
                    best = min(use, key=lambda x: (name.get((x[6] or "").lower(), 9), -(x[7] or datetime(1900, 1, 1)).timestamp(), x[0]))
                    out.add((g, field, best[0]))
    return out


def test_survivors_equal_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in s.survivors(df, TRUST).collect()} == brute(rows)
    assert {tuple(r) for r in s.survivors(df.repartition(7), TRUST).collect()} == brute(rows)


def test_voting_with_ranks_as_prior_equals_the_strict_order(spark):
    for seed in (1, 5):
        rows = made(300, seed)
        out, good, rounds = s.ranked_truth(spark.createDataFrame(rows, SCHEMA), TRUST)
        assert {tuple(r) for r in out.collect()} == brute(rows)
        assert rounds >= 2 and set(good) == {1, 2, 3, s.UNTRUSTED} and good[1] > good[3]


def test_p2_found_runs_no_stage_that_cannot_change_it(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries

    def unused(*_, **__):
        raise AssertionError("reliabilities are estimated that cannot change the strict order")

    rows = made()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/issues.parquet")
    spark.createDataFrame(list(TRUST.items()), "source string, trust_rank int").write.parquet(f"{tmp_path}/source_trust.parquet")
    monkeypatch.setattr(s, "ranked_truth", unused)
    monkeypatch.setattr(s, "discover_truth", unused)
    got = queries()["p2_found"](spark, str(tmp_path))
    assert got.columns == ["finding_id", "field_name", "issue_id"] and sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))


def test_learnt_reliabilities_decide_under_a_weak_prior(spark):
    """Two ranks that disagree: alone the better one wins, unless other groups show that it is mostly wrong."""
    claim = lambda i, g, v, source: (i, g, v, None, None, None, source, None, "x")
    pair = [claim(1, "f", "high", "deterministic"), claim(2, "f", "low", "human_review")]
    others = [claim(10 * g + k, f"g{g}", v, source) for g in range(1, 9) for k, (v, source) in enumerate((("high", "deterministic"), ("low", "human_review"), ("low", "ai_quality+deterministic")))]
    best = lambda rows, **more: {r["finding_id"]: r["issue_id"] for r in s.ranked_truth(spark.createDataFrame(rows, SCHEMA), TRUST, **more)[0].collect()}["f"]
    assert best(pair, prior=1.0) == 1 and best(pair + others, prior=1.0) == 2
    assert best(pair + others) == 1


def test_records_take_each_field_from_its_row(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["finding_id"]: r for r in s.strict_records(df, TRUST).collect()}
    for g, field, ident in brute(rows):
        assert got[g][f"{field}_issue_id"] == ident and got[g][field] is not None


def test_truth_discovery_learns_who_is_right(spark):
    r = random.Random(2)
    rows = []
    for g in range(150):
        truth = r.choice(["high", "low", "medium"])
        for k, (src, right) in enumerate((("deterministic", 0.3), ("ai_quality+deterministic", 0.95), ("human_review", 0.95), ("cli", 0.9))):
            v = truth if r.random() < right else r.choice(["critical", "low", "high", "medium"])
            rows.append((g * 10 + k, f"f{g}", v, None, None, truth, src, None, "x"))
    out, good, rounds = s.discover_truth(spark.createDataFrame(rows, SCHEMA), TRUST)
    good = {r["voter"]: r["reliability"] for r in good.collect()}
    assert 1 <= rounds <= 50 and good["human_review"] > good["deterministic"] and good["cli"] > good["deterministic"]
    got = {r["finding_id"]: r["value"] for r in out.where("field_name = 'severity'").collect()}
    want = {x[1]: x[5] for x in rows}
    assert sum(got[g] == want[g] for g in want) > 140


def test_empty_and_all_null(spark):
    assert s.survivors(spark.createDataFrame([], SCHEMA), TRUST).count() == 0
    assert s.survivors(spark.createDataFrame([(None,) * 9] * 3, SCHEMA), {}).count() == 0
    assert s.ranked_truth(spark.createDataFrame([], SCHEMA), TRUST)[0].count() == 0 == s.strict_records(spark.createDataFrame([], SCHEMA), TRUST).count()
    assert s.discover_truth(spark.createDataFrame([], SCHEMA), {})[0].count() == 0
