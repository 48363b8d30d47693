"""Cubes: grouping sets of every kind, additive, two-level and distinct aggregates, and exact percentiles."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SchemaError
from .aggregates import Aggregate, by_column, column, exact, share
from .buffers import fold, is_buffered
from .percentiles import percentiles
from .pieces import fold_pieces, is_pieced
from .rows import need

Sets = list[tuple[str, ...]]
DIMENSIONS = (T.BooleanType, T.IntegerType, T.LongType, T.StringType)


def all_sets(dims: list[str]) -> Sets:
    return [s for n in range(len(dims), -1, -1) for s in combinations(dims, n)]


def combos(dims: list[str], n: int) -> Sets:
    """Sets of n dimensions or fewer, the grand total among them."""
    return [s for k in range(min(n, len(dims)), -1, -1) for s in combinations(dims, k)]


def rollups(lists: list[tuple[str, ...]]) -> Sets:
    """The product of the lists' prefixes."""
    prefixes = [[one[:k] for k in range(len(one), -1, -1)] for one in lists]
    return list(dict.fromkeys(tuple(c for p in choice for c in p) for choice in product(*prefixes)))


def _checked(dims: list[str], sets: Sets | None) -> Sets:
    sets = all_sets(dims) if sets is None else list(dict.fromkeys(tuple(d for d in dims if d in s) if not set(s) - set(dims) else _unknown(s, dims) for s in sets))
    if not sets:
        raise SchemaError("no grouping sets")
    return sets


def _unknown(s: tuple[str, ...], dims: list[str]):
    raise SchemaError(f"{', '.join(sorted(set(s) - set(dims)))} is no dimension")


ADDITIVE = {"SUM", "COUNT", "MIN", "MAX", "COUNT_TO_ONE"}


def cube(df: DataFrame, dims: list[str], aggregates: list[Aggregate], sets: Sets | None = None, inner: list[str] = (), nulls: str = "raise", grouping: bool = False) -> DataFrame:
    """A row for each cell of each grouping set: the dimensions (null is ALL), then the aggregates.

    An aggregate kind may be `[OUTER, INNER]`: for each cell and inner key the values are folded with INNER, and those
    results with OUTER. COUNT_DISTINCT counts the inner keys of each cell, or without inner keys its column's values.
    A user aggregate is a function of columns, a class with a buffer (see `buffers`), whose measures are the inner keys, or a
    class that takes a cell in pieces (see `pieces`). A grouped pandas_udf asks for all values of a cell in one task's memory.
    nulls: "raise" on a null dimension, as null means ALL, or "keep" them (grouping=True then tells them apart).
    """
    inner = list(inner)
    need(df, [*dims, *inner])
    for d in dims:
        if not isinstance(df.schema[d].dataType, DIMENSIONS):
            raise SchemaError(f"{d} is {df.schema[d].dataType.simpleString()}: dimensions are BOOLEAN, INT, LONG or STRING")
    sets = _checked(list(dims), sets)
    if nulls == "raise":
        for d in dims:
            if df.schema[d].nullable:
                t = df.schema[d].dataType
                df = df.withColumn(d, F.when(F.col(d).isNull(), F.raise_error(F.lit(f"null in dimension {d}")).cast(t)).otherwise(F.col(d)))
    gid = F.grouping_id().alias("_gid")
    plain = [a for a in aggregates if not a.kind.startswith("[") and not (a.kind.upper() == "COUNT_DISTINCT" and inner)]
    ranked = [a for a in plain if exact(a, df.schema)]
    buffered = [a for a in plain if is_buffered(a.user)]
    pieced = [a for a in plain if is_pieced(a.user) and a not in buffered]
    plain = [a for a in plain if a not in ranked and a not in buffered and a not in pieced]
    dual = [a for a in aggregates if a.kind.startswith("[")]
    members = [a for a in aggregates if a.kind.upper() == "COUNT_DISTINCT" and inner]
    if dual and not inner:
        raise SchemaError("a two-level aggregate needs INNER dimensions")
    parts: list[DataFrame] = []
    if plain or ranked or buffered or pieced:
        parts.append(df.groupingSets([list(s) for s in sets], *dims).agg(gid, *(column(_additive(a), df.schema).alias(a.output) for a in plain)))
    if dual or members:
        # cells are expanded with the inner key kept, folded, and folded again
        kinds = [tuple(x.strip().upper() for x in a.kind.strip("[]").split(",")) for a in dual]
        for pair in kinds:
            if len(pair) != 2 or not set(pair) <= ADDITIVE:
                raise SchemaError(f"no two-level aggregate [{', '.join(pair)}]")
        low = [column(_additive(Aggregate(k[1], a.columns)), df.schema).alias(f"_v{i}") for i, (k, a) in enumerate(zip(kinds, dual, strict=True))]
        known = F.count(F.when(~_any_null(inner), F.lit(1))).alias("_there")
        cells = df.groupingSets([[*s, *inner] for s in sets], *dims, *inner).agg(gid, known, *low)
        high = [column(_additive(Aggregate(k[0], (f"_v{i}",))), cells.schema).alias(a.output) for i, (k, a) in enumerate(zip(kinds, dual, strict=True))]
        high += [F.count(F.when(F.col("_there") > 0, F.lit(1))).alias(a.output) for a in members]
        bits = len(inner)
        cells = cells.withColumn("_gid", F.shiftright("_gid", bits))
        parts.append(cells.groupBy(*dims, "_gid").agg(*high))
    for c, some in by_column(ranked).items():  # counts of values by the finest cell, then by all
        counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(*dims, F.col(f"`{c}`").cast("double").alias("_value")).agg(F.count("*").alias("_n"))
        counts = counts.groupingSets([[*s, "_value"] for s in sets], *dims, "_value").agg(F.shiftright(F.grouping_id(), 1).alias("_gid"), F.sum("_n").alias("n"))
        cells = counts.select(F.struct("_gid", *dims).alias("cell"), F.col("_value").alias("value"), "n")
        parts.append(percentiles(cells, {a.output: share(a) for a in some}).select("cell.*", *(a.output for a in some)))
    parts += [fold(df, list(dims), sets, inner, a.columns, a.user, a.output) for a in buffered]
    parts += [fold_pieces(df, list(dims), sets, a.columns, a.user, a.output) for a in pieced]
    out = parts[0]
    for other in parts[1:]:
        right = other.select(*(F.col(c).alias(f"_r_{c}" if c in (*dims, "_gid") else c) for c in other.columns))
        on = [out[c].eqNullSafe(right[f"_r_{c}"]) for c in (*dims, "_gid")]
        out = out.join(right, on, "left").drop(*(f"_r_{c}" for c in (*dims, "_gid")))
    names = [*dims, *(["grouping_id"] if grouping else []), *(a.output for a in aggregates)]
    return out.withColumnRenamed("_gid", "grouping_id").select(*names)


def _any_null(columns: list[str]):
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def _additive(a: Aggregate) -> Aggregate:
    """COUNT_TO_ONE folds to 1 where there is a value: how an inner key counts once."""
    if a.kind.upper() == "COUNT_TO_ONE":
        return Aggregate("USER", a.columns, a.name, user=lambda x: F.max(F.when(x.isNotNull(), F.lit(1).cast("long"))))
    return a
