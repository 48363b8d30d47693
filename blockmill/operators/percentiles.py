"""Exact percentiles of many cells, without holding a cell's values in one place.

Equal values of a cell are counted first. The counts are dealt by ranges of (cell, value) and written; the ranges' sums tell
in which range a wanted position lies, and only those ranges are read again, to add up to the position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .rows import in_ranges

EXACT = ("MEDIAN", "PERCENTILE")


def percentiles(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(cell, and a column for each share) from (cell, value, n): the value at (rows - 1) * share, between two values in proportion.

    cell is of any type that can be ordered; cells without values have no row.
    """
    placed = Scratch(counts.sparkSession, "percentiles").write(in_ranges(counts, ["cell", "value"], "_place"), "rows")
    ranges = placed.groupBy("cell", F.shiftright("_place", 33).alias("part")).agg(F.sum("n").alias("n"))
    every = Window.partitionBy("cell")
    upto = F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.select("cell", "part", "n", (upto - F.col("n")).alias("start"), F.sum("n").over(every).alias("rows"))
    names = list(shares)
    at = [(F.col("rows") - 1) * F.lit(float(p)) for p in shares.values()]
    asked = F.array(*(F.struct(F.lit(2 * k + side).alias("ask"), f(x).cast("long").alias("k")) for k, x in enumerate(at) for side, f in enumerate((F.floor, F.ceil))))
    inside = F.filter(asked, lambda a: (a["k"] >= F.col("start")) & (a["k"] < F.col("start") + F.col("n")))
    wanted = ranges.select("cell", "part", "start", "rows", inside.alias("asked")).where(F.size("asked") > 0)
    read = placed.withColumn("part", F.shiftright("_place", 33)).join(wanted, ["cell", "part"])
    reached = F.col("start") + F.sum("n").over(Window.partitionBy("cell", "part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    hit = read.withColumn("reached", reached).select("cell", "rows", "value", F.explode(F.filter("asked", lambda a: (a["k"] >= F.col("reached") - F.col("n")) & (a["k"] < F.col("reached")))).alias("a"))
    found = hit.groupBy("cell").agg(F.first("rows").alias("rows"), *(F.max(F.when(F.col("a.ask") == j, F.col("value"))).alias(f"v{j}") for j in range(2 * len(names))))
    return found.select("cell", *(_between(x, F.col(f"v{2 * k}"), F.col(f"v{2 * k + 1}")).alias(n) for k, (n, x) in enumerate(zip(names, at, strict=True))))


def _between(at: Column, low: Column, high: Column) -> Column:
    lower, upper = F.floor(at), F.ceil(at)
    return F.when(lower == upper, low).otherwise((upper - at) * low + (at - lower) * high)
