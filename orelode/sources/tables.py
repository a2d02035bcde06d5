"""Parquet sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that may come to the driver; ``small_rows`` checks it.
SMALL_ROWS = 10_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list:
    """All rows of a table that is small by its definition; fails beyond ``limit`` instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table meant for the driver has more than {limit} rows")
    return rows


def budget(spark: SparkSession, root: str, name: str) -> tuple[int, int]:
    """(capacity, overlap) of one row of budgets; a missing overlap is 0."""
    from pyspark.sql import functions as F

    for row in small_rows(table(spark, root, "budgets").where(F.col("budget_name") == name)):
        return int(row["capacity"]), int(row["overlap_size"] or 0)
    raise KeyError(f"no budget {name!r}")
