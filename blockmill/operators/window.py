"""RANK and TOP."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import need, number


def rank(df: DataFrame, name: str, group: list[str] = (), order: list[str] = ()) -> DataFrame:
    """1, 2, 3, … in each group in the given order (ties get different numbers), or over all rows without a group."""
    need(df, [*group, *order])
    if not group:
        return number(df, list(order) or df.columns, name)
    by = [F.col(c).asc_nulls_first() for c in order]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*by)).cast("long"))


def top(df: DataFrame, group: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows of each group before the shuffle already."""
    need(df, [*group, *order])
    by = [F.col(c).asc_nulls_first() for c in order]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col("_rank") <= n).drop("_rank")
