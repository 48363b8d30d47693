"""Projection, filters and other operators on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from ..types import SchemaError, wider


def need(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")


def generate(df: DataFrame, *expressions: tuple[str, Column]) -> DataFrame:
    """(name, column) pairs, in order."""
    return df.select(*(c.alias(n) for n, c in expressions))


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; null is not true."""
    return df.filter(predicate)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def duplicate(df: DataFrame, n: int, counter: str = "counter") -> DataFrame:
    """Each row n times, with a counter 0 … n - 1 as the last column."""
    if n < 1:
        raise SchemaError("DUPLICATE needs one time or more")
    return df.withColumn(counter, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def flatten(df: DataFrame, items: list[tuple[str, str, list[tuple[str, T.DataType]]]]) -> DataFrame:
    """(column, TUPLE | BAG | BAG_TUPLE, [(name, type)]): tuples become columns, bags a row for each element, in place.

    A null or empty bag gives one row of nulls; several bags give all combinations of their elements.
    """
    need(df, [c for c, _, _ in items])
    order = list(df.columns)
    for column, kind, fields in items:
        kind = kind.upper()
        t = df.schema[column].dataType
        if kind in ("BAG", "BAG_TUPLE"):
            if not isinstance(t, T.ArrayType):
                raise SchemaError(f"{column} is no bag")
            df, t = df.withColumn(column, F.explode_outer(column)), t.elementType
        elif kind != "TUPLE":
            raise SchemaError(f"FLATTEN as {kind}")
        at = order.index(column)
        if kind == "BAG":
            name, to = fields[0]
            inner = isinstance(t, T.StructType) and len(t) == 1 and not isinstance(to, T.StructType)
            value = F.col(column).getField(t.fields[0].name) if inner else F.col(column)
            df = df.withColumn(column, value if isinstance(to, (T.StructType, T.ArrayType)) else value.cast(to)).withColumnRenamed(column, name)
            order[at : at + 1] = [name]
            continue
        if isinstance(t, T.StructType):
            if len(t) < len(fields):
                raise SchemaError(f"{column} has {len(t)} fields")
            values = [F.col(column).getField(f.name).cast(to) for f, (_, to) in zip(t.fields, fields, strict=False)]
        elif len(fields) == 1:
            values = [F.col(column).cast(fields[0][1])]
        else:
            raise SchemaError(f"{column} has no fields")
        names = [n for n, _ in fields]
        others = [F.col(c) for c in df.columns if c != column]
        df = df.select(*others, *(v.alias(n) for v, n in zip(values, names, strict=True)))
        order[at : at + 1] = names
    return df.select(*order)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort(df: DataFrame, columns: list[str], whole: bool = False) -> DataFrame:
    """Sorted within partitions, or over all rows; ascending, nulls first."""
    need(df, columns)
    by = [F.col(c).asc_nulls_first() for c in columns]
    return df.orderBy(*by) if whole else df.sortWithinPartitions(*by)


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows, by column name, of frames with the same columns; number types widen."""
    first = frames[0]
    kinds = {f.name: f.dataType for f in first.schema}
    for df in frames[1:]:
        if set(df.columns) != set(first.columns):
            raise SchemaError(f"columns differ: {', '.join(first.columns)} and {', '.join(df.columns)}")
        for f in df.schema:
            kind = wider(kinds[f.name], f.dataType)
            if kind is None:
                raise SchemaError(f"types of {f.name} don't meet")
            kinds[f.name] = kind
    return reduce(DataFrame.unionByName, [df.select(*(F.col(c).cast(kinds[c]).alias(c) for c in first.columns)) for df in frames])


def combine(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """All rows in order of the columns within each partition."""
    return sort(union(frames), columns)


def gather(frames: list[DataFrame]) -> DataFrame:
    """The outputs of several passes over the same rows; schemas must be equal."""
    if any([(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in frames[0].schema] for df in frames[1:]):
        raise SchemaError("GATHER of different schemas")
    return reduce(DataFrame.unionByName, frames)


def pivot_by_row(df: DataFrame, n: int, order_by: list[str], name: str = "_group") -> DataFrame:
    """A group number for every n rows in the order of the columns.

    Positions come from `number`, so that no window spans all rows.
    """
    return number(df, order_by, "_position").withColumn(name, F.floor((F.col("_position") - 1) / n).cast("long")).drop("_position")


def number(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """1, 2, … over all rows in the order of the columns, without gathering them in one task.

    Rows are dealt by ranges of the order, sorted in them, and written to the shared folder with their place (the range in
    the upper bits). Sizes and rows are read from that one table, so that both know the same ranges; each range begins where
    those before it end, and only the ranges' sizes meet in one place. Ties are numbered in no fixed order: name enough columns.
    """
    need(df, order_by)
    placed = Scratch(df.sparkSession, "number").write(in_ranges(df, order_by, "_place"), "rows")
    return placed.join(F.broadcast(starts(placed, "_place")), F.shiftright("_place", 33) == F.col("_part")).withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_place", "_start")


def in_ranges(df: DataFrame, order_by: list[str], place: str) -> DataFrame:
    """Rows by ranges of the order, sorted, with a number that grows with it: the range in bits 33 and above, the row below."""
    by = [F.col(c).asc_nulls_first() for c in order_by]
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id())


def starts(placed: DataFrame, place: str, size: Column | None = None) -> DataFrame:
    """(_part, _start): rows, or the sum of size, in the ranges before each. A row for each range."""
    sizes = placed.groupBy(F.shiftright(place, 33).alias("_part")).agg((F.count("*") if size is None else F.sum(size)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def tee(df: DataFrame, write, columns: list[tuple[str, Column]] | None = None, predicate: Column | None = None, split: bool = False) -> DataFrame:
    """Writes rows aside (those of the predicate, projected); passes on all rows, or with split those not written."""
    true = F.coalesce(predicate, F.lit(False)) if predicate is not None else F.lit(True)
    aside = df.filter(true)
    write(generate(aside, *columns) if columns else aside)
    return df.filter(~true) if split else df


def no_op(df: DataFrame) -> DataFrame:
    return df


def purge(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id isn't in the one column of ids; null ids stay."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti").select(*df.columns)


def force_sorted_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, once its rows are known to come in order of the columns (nulls first) within each partition; else it raises.

    The check is a job of its own over the order columns alone.
    """
    need(df, columns)
    now = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)))
    seen = df.select(now.alias("now"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    wrong = seen.withColumn("last", F.lag("now").over(Window.partitionBy("part").orderBy("row"))).where("last > now").count()
    if wrong:
        raise SchemaError(f"{wrong} rows aren't in the order of {', '.join(columns)}")
    return df


def least_entry(df: DataFrame, column: str, field: int, name: str) -> DataFrame:
    """The element of a bag of tuples whose field (0, 1, …) is least; nulls come last."""
    fields = df.schema[column].dataType.elementType.fields
    key, every = fields[field].name, [f.name for f in fields]
    keyed = F.transform(F.filter(column, lambda x: x.isNotNull()), lambda x: F.struct(x.getField(key).isNull().alias("_null"), x.getField(key).alias("_key"), *(x.getField(f).alias(f"v_{f}") for f in every)))
    best = F.array_min(keyed)
    return df.withColumn(name, F.when(best.isNotNull(), F.struct(*(best.getField(f"v_{f}").alias(f) for f in every))))


def collate_vectors(meta: DataFrame, data: DataFrame, id_col: str, coordinate_meta: str, coordinate_data: str) -> DataFrame:
    """Data rows of all the coordinates that each meta row lists, with its id as meta___id; ids that lack one are left out."""
    listed = meta.select(F.col(id_col).alias("meta___id"), F.col(coordinate_meta).alias("_at")).distinct()
    wanted = listed.groupBy("meta___id").agg(F.count("*").alias("_wanted"))
    there = data.select(F.col(coordinate_data).alias("_at")).distinct()
    found = listed.join(there, "_at").groupBy("meta___id").agg(F.count("*").alias("_found"))
    whole = wanted.join(found, "meta___id").where("_wanted = _found").select("meta___id")
    return data.join(listed.join(whole, "meta___id"), data[coordinate_data] == F.col("_at")).drop("_at")
