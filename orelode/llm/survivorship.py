"""One surviving record for each group of duplicate records.

The operators share the preparation of the claims (a claim is one usable value of one field in one row):

``survivors``       the strict order by rank, then recency, then id, by one grouped minimum; ``strict_records`` is the same with the values. No
                    estimated reliability can have a say in a strict order, so none is estimated here.
``ranked_truth``    iterative truth discovery with a prior: each trust rank casts one vote per group and field, with its latest claim. A
                    vote weighs prior times reliability; reliabilities and votes are estimated alternately until the choices settle.
                    A rank's prior is ``prior`` times that of the next. Reliabilities lie from 1/2 to 1: below 3 the reliabilities can change
                    a choice, from 3 on (4 by default) a rank outweighs all lower ones together, which makes the result the strict order
                    and the reliabilities a mere report. One exchange: the ranks are few, so a group's votes are one row, and a
                    round is one pass over these rows.
``discover_truth``  the same without a prior: one voter per source, reliabilities learnt, no source preferred beyond its start value.

Defined cases: rows without a group key or without an id take no part; a group needs at least two different ids; values
that stand in for nothing never compete; a field without a usable value yields no row; replayed rows change nothing;
an empty table yields an empty result; further columns are ignored. Rounds that do not settle raise an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.session import cut_lineage

# Texts that stand in for a missing value, in lower case without outer spaces and full stops.
NOTHING = (
    "", "n/a", "na", "n.a", "none", "null", "nil", "nan", "undefined", "unknown", "tbd", "tba", "todo", "not available",
    "not applicable", "no suggestion", "no specific suggestion available", "no evidence", "missing", "empty", "pending",
    "to be done", "to be determined", "not set", "unset", "no data", "no value", "xxx",
)
# The severities.
SEVERITIES = ("critical", "high", "medium", "low")


def plain(c: Column) -> Column:
    """Lower case, outer white space removed."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def usable_text(c: Column) -> Column:
    """Whether a text says something: no stand-in, and at least one letter or digit. False for null."""
    core = F.regexp_replace(plain(c), r"^[<\[({\s]+|[>\])}.\s]+$", "")
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]") & ~core.isin(*NOTHING), F.lit(False))


def usable_severity(c: Column) -> Column:
    return F.coalesce(plain(c).isin(*SEVERITIES), F.lit(False))


def usable_confidence(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c <= 1) & ~F.isnan(c), F.lit(False))


def source_key(c: Column) -> Column:
    """A source's name without differences of spelling: case, spaces, hyphens, order of the parts of a combined source."""
    parts = F.transform(F.split(plain(c), r"\+"), lambda p: F.regexp_replace(F.trim(p), r"[\s\-_]+", "_"))
    return F.array_join(F.array_sort(F.array_distinct(parts)), "+")


@dataclass(frozen=True)
class Field:
    """A field to merge: its name, when a value is usable, and the form in which two values count as equal."""

    name: str
    usable: object
    form: object = staticmethod(lambda c: plain(c.cast("string")))


ISSUE_FIELDS = (
    Field("severity", usable_severity),
    Field("confidence", usable_confidence, lambda c: F.round(c.cast("double"), 6).cast("string")),
    Field("fix_suggestion", usable_text),
    Field("evidence", usable_text),
)
UNTRUSTED = 1 << 30


def _prepared(rows: DataFrame, trust: dict[str, int], group: str, ident: str, source: str, recency: str, fields) -> DataFrame:
    """The columns needed, with the key, the source's rank and the time as a number that sorts late times first."""
    src = source_key(F.col(source))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(trust.items()) for x in kv])[src], F.lit(UNTRUSTED)) if trust else F.lit(UNTRUSTED)
    late = F.coalesce(-F.unix_micros(F.col(recency).cast("timestamp")), F.lit((1 << 63) - 1))
    return rows.select(
        plain(F.col(group)).alias("_group"), F.col(ident).cast("bigint").alias("_id"), rank.alias("_rank"), late.alias("_late"),
        F.coalesce(src, F.lit("")).alias("_source"), *[F.col(f.name).alias(f"_v_{f.name}") for f in fields],
    ).where((F.col("_group") != "") & F.col("_id").isNotNull())


def trust_of(source_trust: DataFrame) -> dict[str, int]:
    """Ranks by spelling-free source name, from a table of checked size."""
    from orelode.sources.tables import small_rows

    t = source_trust.select(source_key(F.col("source")).alias("s"), F.col("trust_rank").cast("int").alias("r"))
    return {r["s"]: r["r"] for r in small_rows(t.where("s is not null and r is not null").groupBy("s").agg(F.min("r").alias("r")))}


def survivors(
    rows: DataFrame, trust: dict[str, int], group: str = "finding_id", ident: str = "issue_id", source: str = "source",
    recency: str = "created_at", fields=ISSUE_FIELDS, singles: bool = False,
) -> DataFrame:
    """(group, field_name, id) of the surviving value of each field, for each group with two or more different ids, or with ``singles`` for every group.

    The order is lower rank, later time (missing last), smaller id. See the module's text for the defined cases.
    """
    p = _prepared(rows, trust, group, ident, source, recency, fields)
    order = F.struct("_rank", "_late", "_id")
    best = p.groupBy("_group").agg(
        F.min("_id").alias("_least"), F.max("_id").alias("_most"),
        *[F.min(F.when(f.usable(F.col(f"_v_{f.name}")), order)).alias(f"_b_{f.name}") for f in fields],
    ).where("true" if singles else "_least <> _most")
    pairs = F.array(*[F.struct(F.lit(f.name).alias("field_name"), F.col(f"_b_{f.name}._id").alias("id")) for f in fields])
    return (
        best.select(F.col("_group").alias(group), F.inline(pairs)).where("id is not null")
        .select(group, "field_name", F.col("id").alias(ident))
    )


def strict_records(
    rows: DataFrame, trust: dict[str, int], group: str = "finding_id", ident: str = "issue_id", source: str = "source",
    recency: str = "created_at", fields=ISSUE_FIELDS,
) -> DataFrame:
    """One record per group, those with one id or no usable value too: each field's surviving value with the id of its row.

    The values travel with their order, so there is one scan and one exchange. Rows that share rank, time and id are replays of one
    row; should they differ, the smallest value counts.
    """
    p = _prepared(rows, trust, group, ident, source, recency, fields)
    best = p.groupBy("_group").agg(*[
        F.min(F.when(f.usable(F.col(f"_v_{f.name}")), F.struct("_rank", "_late", "_id", F.trim(F.col(f"_v_{f.name}").cast("string")).alias("value")))).alias(f.name) for f in fields
    ])
    return best.select(F.col("_group").alias(group), *[x for f in fields for x in (F.col(f"{f.name}.value").alias(f.name), F.col(f"{f.name}._id").alias(f"{f.name}_{ident}"))])


def ranked_truth(
    rows: DataFrame, trust: dict[str, int], group: str = "finding_id", ident: str = "issue_id", source: str = "source",
    recency: str = "created_at", fields=ISSUE_FIELDS, tolerance: float = 1e-6, max_rounds: int = 20, prior: float = 4.0,
) -> tuple[DataFrame, dict[int, float], int]:
    """Truth discovery with trust ranks as prior: (rows, reliability by rank, rounds).

    rows: group, field_name, id of the best row with the chosen value. Sources without a rank vote as one rank, the last. See the module's text.
    """
    p = _prepared(rows, trust, group, ident, source, recency, fields)
    ranks = [*sorted(set(trust.values())), UNTRUSTED]
    order = {r: k for k, r in enumerate(ranks)}

    def claim(f: Field, r: int) -> Column:
        form = F.xxhash64(f.form(F.col(f"_v_{f.name}")))
        return F.min(F.when(f.usable(F.col(f"_v_{f.name}")) & (F.col("_rank") == r), F.struct("_late", "_id", form.alias("value"))))

    grouped = p.groupBy("_group").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"), *[claim(f, r).alias(f"_c_{f.name}_{order[r]}") for f in fields for r in ranks])
    votes = [
        F.struct(F.lit(f.name).alias("field_name"), F.filter(F.array(*[
            F.when(F.col(f"_c_{f.name}_{k}").isNotNull(), F.struct(F.lit(k).alias("rank"), F.col(f"_c_{f.name}_{k}._id").alias("id"), F.col(f"_c_{f.name}_{k}.value").alias("value"))) for k in range(len(ranks))
        ]), lambda v: v.isNotNull()).alias("votes")) for f in fields
    ]
    claims = cut_lineage(grouped.where("_least <> _most").select("_group", F.inline(F.array(*votes))).where(F.size("votes") > 0))
    good = {k: 0.9 for k in range(len(ranks))}

    def chosen(good: dict[int, float]) -> DataFrame:
        weight = F.array(*[F.lit(prior ** (len(ranks) - k) * good[k]) for k in range(len(ranks))])
        support = F.transform("votes", lambda v: F.struct(
            F.aggregate("votes", F.lit(0.0), lambda s, o: s + F.when(o["value"] == v["value"], F.element_at(weight, o["rank"] + 1)).otherwise(0.0)).alias("support"), (-v["rank"]).alias("better"), v.alias("vote")))
        return claims.select("_group", "field_name", "votes", F.array_max(support)["vote"].alias("best"))

    for rounds in range(1, max_rounds + 1):
        agreed = chosen(good).select(F.col("best.value").alias("is"), F.inline("votes")).groupBy("rank").agg(F.count("*").alias("n"), F.count_if(F.col("value") == F.col("is")).alias("h"))
        new = good | {r["rank"]: 0.5 + 0.5 * (r["h"] + 1) / (r["n"] + 2) for r in agreed.collect()}  # one row for each rank
        moved = max(abs(new[k] - good[k]) for k in good)
        good = new
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"truth discovery has not settled after {max_rounds} rounds")
    out = chosen(good).select(F.col("_group").alias(group), "field_name", F.col("best.id").alias(ident))
    return out, {r: good[k] for r, k in order.items()}, rounds


def discover_truth(
    rows: DataFrame, trust: dict[str, int], group: str = "finding_id", ident: str = "issue_id", source: str = "source",
    recency: str = "created_at", fields=ISSUE_FIELDS, tolerance: float = 1e-3, max_rounds: int = 50,
) -> tuple[DataFrame, DataFrame, int]:
    """Iterative truth discovery: (values, reliabilities, rounds).

    values: group, field_name, value (in comparable form), support (share of the weighted votes), sources, id (the best
    row with that value by rank, time, id). reliabilities: voter, reliability, claims.
    A source's weight is ln(1/(1-reliability)). Reliability starts from the trust rank and becomes the share of a source's claims that
    agree with the current choice (smoothed by one claim either way). Every source votes for itself, missing ones together as "".
    Replays count once: one vote per (group, field, value, source). Ties go to the best row by rank, time, id. Groups with one
    id teach nothing and are left out before the votes. Claims are collapsed to one row per (group, field, value) with the list of their voters (at
    most one entry per source); reliabilities are a table that Spark joins by the voter, so nothing but one number per round reaches the driver.
    """
    p = _prepared(rows, trust, group, ident, source, recency, fields)
    several = p.groupBy("_group").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least <> _most").select("_group")
    claim = F.array(*[
        F.struct(F.lit(f.name).alias("field_name"), F.when(f.usable(F.col(f"_v_{f.name}")), f.form(F.col(f"_v_{f.name}"))).alias("value")) for f in fields
    ])
    claims = cut_lineage(
        p.join(several, "_group", "left_semi").select("_group", "_id", "_rank", "_late", F.col("_source").alias("voter"), F.inline(claim)).where("value is not null")
        .groupBy("_group", "field_name", "value", "voter").agg(F.min(F.struct("_rank", "_late", "_id")).alias("best"))
    )
    last = max([0, *trust.values()]) + 1
    start = F.when(F.min("best._rank") < UNTRUSTED, 0.9 - 0.5 * (F.min("best._rank") - 1) / max(1, last - 1)).otherwise(0.4)
    good = cut_lineage(claims.groupBy("voter").agg(start.alias("reliability"), F.count("*").alias("claims")))
    for rounds in range(1, max_rounds + 1):
        weight = -F.log(1 - F.least("reliability", F.lit(0.999)))
        votes = claims.join(good.select("voter", weight.alias("w")), "voter").groupBy("_group", "field_name", "value").agg(
            F.sum("w").alias("votes"), F.count("*").alias("sources"), F.min("best").alias("best"), F.collect_list("voter").alias("voters"))
        key = F.struct((-F.round("votes", 9)).alias("v"), "best", "value", "votes", "sources", "voters")
        settled = votes.groupBy("_group", "field_name").agg(F.min(key).alias("k"), F.sum("votes").alias("all"))
        hits = settled.select(F.explode("k.voters").alias("voter")).groupBy("voter").agg(F.count("*").alias("h"))
        new = cut_lineage(good.join(hits, "voter", "left").select("voter", "claims", F.col("reliability").alias("was"), ((F.coalesce("h", F.lit(0)) + 1) / (F.col("claims") + 2)).alias("reliability")))
        moved = new.agg(F.max(F.abs(F.col("reliability") - F.col("was")))).first()[0]
        good = new.select("voter", "reliability", "claims")
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"truth discovery has not settled after {max_rounds} rounds")
    values = settled.select(
        F.col("_group").alias(group), "field_name", F.col("k.value").alias("value"), F.round(F.col("k.votes") / F.col("all"), 6).alias("support"), F.col("k.sources").alias("sources"), F.col("k.best._id").alias(ident))
    return values, good, rounds
