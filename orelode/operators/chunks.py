"""Symbol-aware chunks of files: outermost functions and classes, what lies between them as "module", long ones packed by lines.

All of it is window arithmetic over the symbol table and a fold over lines; no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters in a chunk, chunks of a file, calls in all.
CHARS, PER_FILE, CALLS = 6000, 8, 48


def cover(symbols: DataFrame) -> DataFrame:
    """(file_id, name, start_line, end_line): symbols by start, longer first, each kept if it begins behind everything kept before it.

    A symbol that begins within an earlier one is inside or crossing it; as starts ascend, the greedy cover keeps exactly those that begin behind the highest end so far of the kept ones,
    which is a fold over the file's symbols in order.
    """
    s = symbols.where("start_line is not null and end_line >= start_line").select("file_id", "name", "start_line", "end_line").distinct()
    ordered = s.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", (-F.col("end_line")).alias("e"), "name", "end_line"))).alias("all"))
    empty = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", empty, lambda a, x: F.when((F.size(a) == 0) | (x["start_line"] > F.coalesce(F.get(a, F.size(a) - 1)["end_line"], F.lit(0))), F.concat(a, F.array(x))).otherwise(a))
    return ordered.select("file_id", F.inline(kept)).select("file_id", "name", "start_line", "end_line")


def spans(kept: DataFrame, lengths: DataFrame) -> DataFrame:
    """Kept symbols and the gaps before, between and behind them as ``module``; lengths: file_id, lines."""
    w = Window.partitionBy("file_id").orderBy("start_line")
    k = kept.join(lengths, "file_id").where("start_line <= lines").withColumn("end_line", F.least("end_line", "lines")).withColumn("last", F.coalesce(F.lag("end_line").over(w), F.lit(0))).withColumn("next", F.lead("start_line").over(w))
    gaps_before = k.where("start_line > last + 1").select("file_id", F.lit("module").alias("name"), (F.col("last") + 1).alias("start_line"), (F.col("start_line") - 1).alias("end_line"))
    tail = k.where("next is null and end_line < lines").select("file_id", F.lit("module").alias("name"), (F.col("end_line") + 1).alias("start_line"), F.col("lines").alias("end_line"))
    none = lengths.join(k.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit("module").alias("name"), F.lit(1).alias("start_line"), F.col("lines").alias("end_line"))
    return k.select("file_id", "name", "start_line", "end_line").unionByName(gaps_before).unionByName(tail).unionByName(none)


def packs(lines: Column, capacity: int = CHARS) -> Column:
    """Places (first, last) of packs of whole lines of at most ``capacity`` characters with their line ends; a longer line stands alone."""
    start = F.named_struct(F.lit("done"), F.expr("cast(array() as array<struct<first:int,last:int>>)"), F.lit("first"), F.lit(1), F.lit("at"), F.lit(0), F.lit("size"), F.lit(0))

    def step(a: Column, line: Column) -> Column:
        n = F.length(line) + 1
        full = (a["size"] > 0) & (a["size"] + n > capacity)
        done = F.when(full, F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["at"].alias("last"))))).otherwise(a["done"])
        return F.named_struct(F.lit("done"), done, F.lit("first"), F.when(full, a["at"] + 1).otherwise(a["first"]), F.lit("at"), a["at"] + 1, F.lit("size"), F.when(full, n).otherwise(a["size"] + n))

    return F.aggregate(lines, start, step, lambda a: F.when(a["at"] >= a["first"], F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["at"].alias("last"))))).otherwise(a["done"]))


def header(path: Column, first: Column, last: Column, name: Column) -> Column:
    return F.concat(F.lit("# FILE: "), path, F.lit("\n# LINES: "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n# SYMBOL: "), name, F.lit("\n"))


def enclosing(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """places (file_id, line, ...) with the name of the smallest symbol around the line, null if there is none."""
    s = symbols.where("end_line >= start_line").select("file_id", "name", "start_line", "end_line").distinct()
    hit = places.join(s, "file_id").where("line between start_line and end_line")
    best = hit.groupBy(*places.columns).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line", "name")).alias("b"))
    return best.select(*places.columns, F.col("b.name").alias("symbol"))
