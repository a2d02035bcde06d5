"""Difference texts of two versions of a text."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def unified(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, diff): the unified difference, "" for equal texts. A null on either side counts as an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            diffs = ["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), "before", "after")) for a, b in zip(f[before], f[after])]
            yield pd.DataFrame({key: f[key], "diff": diffs})

    return rows.selectExpr(f"cast({key} as bigint) {key}", before, after).mapInPandas(run, f"{key} bigint, diff string")
