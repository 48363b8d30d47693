"""GROUP BY and its aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import bag_of, presence_bitmap
from ..types import SchemaError, is_number
from .percentiles import EXACT, percentiles
from .rows import need


@dataclass(frozen=True)
class Aggregate:
    """kind: SUM, COUNT, MIN, MAX, COUNT_DISTINCT, BITWISE_OR, BAG, CREATE_ARRAYLIST, CREATE_ARRAY, PRESENCE_BITMAP, MEDIAN, PERCENTILE, or USER."""

    kind: str
    columns: tuple[str, ...] = ()
    name: str | None = None
    user: Callable[..., Column] | None = None
    args: tuple = field(default=())

    @property
    def output(self) -> str:
        if self.name:
            return self.name
        prefix = {"CREATE_ARRAY": "ARRAY", "PRESENCE_BITMAP": "PresenceMap"}.get(self.kind, self.kind)
        return f"{prefix}___{self.columns[0]}" if self.columns else self.kind.lower()


def column(a: Aggregate, schema: T.StructType, strict: bool = False) -> Column:
    """strict: SUM keeps the input's type and wraps around, where by default whole numbers sum to LONG."""
    kind = a.kind.upper()
    for c in a.columns:
        if c not in schema.names:
            raise SchemaError(f"no column {c}")
    x = F.col(f"`{a.columns[0]}`") if a.columns else None
    t = schema[a.columns[0]].dataType if a.columns else None
    if isinstance(a.user, type):
        raise SchemaError(f"{a.user.__name__} is an aggregate of cubes")
    if a.user is not None:
        return a.user(*(F.col(f"`{c}`") for c in a.columns))
    if kind == "COUNT":
        return F.count("*") if x is None else F.count(x)
    if x is None:
        raise SchemaError(f"{kind} needs a column")
    if kind in ("SUM", "MIN", "MAX") and not is_number(t):
        raise SchemaError(f"{kind} of {t.simpleString()}")
    if kind == "SUM":
        if not strict or t not in (T.IntegerType(), T.LongType()):
            return F.sum(x)
        from ..functions.builtin import wrap

        return wrap(F.sum(x.cast("decimal(20,0)")), t) if t == T.LongType() else wrap(F.sum(x), t)
    if kind in ("MIN", "MAX"):
        return F.min(x) if kind == "MIN" else F.max(x)
    if kind == "COUNT_DISTINCT":
        return F.countDistinct(x)
    if kind == "BITWISE_OR":
        if t not in (T.IntegerType(), T.LongType()):
            raise SchemaError(f"BITWISE_OR of {t.simpleString()}")
        return F.bit_or(x)
    if kind in ("BAG", "CREATE_ARRAYLIST"):
        return bag_of(x)
    if kind == "CREATE_ARRAY":
        return F.collect_list(x)
    if kind == "PRESENCE_BITMAP":
        return presence_bitmap(x, *a.args)
    raise SchemaError(f"unknown aggregate {a.kind}")


def share(a: Aggregate) -> float:
    p = 0.5 if a.kind.upper() == "MEDIAN" else float(a.args[0])
    if not 0 <= p <= 1:
        raise SchemaError(f"no percentile {p}")
    return p


def exact(a: Aggregate, schema: T.StructType) -> bool:
    """Whether it is a percentile, which `percentiles` works out; others are folded by Spark."""
    if a.user is not None or a.kind.upper() not in EXACT:
        return False
    if not a.columns or a.columns[0] not in schema.names:
        raise SchemaError(f"{a.kind} needs a column")
    if not is_number(schema[a.columns[0]].dataType):
        raise SchemaError(f"{a.kind} of {schema[a.columns[0]].dataType.simpleString()}")
    return True


def by_column(aggregates: list[Aggregate]) -> dict[str, list[Aggregate]]:
    out: dict[str, list[Aggregate]] = {}
    for a in aggregates:
        out.setdefault(a.columns[0], []).append(a)
    return out


def group(df: DataFrame, by: list[str], aggregates: list[Aggregate] = (), strict: bool = False) -> DataFrame:
    """A row for each group: its keys, then the aggregates. Without aggregates, the distinct keys. Null keys are a group.

    by=[] is GROUP ALL: one row, and none if there are no rows.
    """
    need(df, by)
    ranked = [a for a in aggregates if exact(a, df.schema)]
    columns = [column(a, df.schema, strict).alias(a.output) for a in aggregates if a not in ranked]
    if not by and not aggregates:
        raise SchemaError("GROUP ALL needs aggregates")
    if not ranked:
        if not by:
            return df.agg(F.count("*").alias("_rows"), *columns).where("_rows > 0").drop("_rows")
        return df.groupBy(*by).agg(*columns) if columns else df.select(*by).distinct()
    keys = [F.col(f"`{c}`") for c in by]
    out = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *columns).where("_rows > 0").withColumn("cell", F.struct(F.lit(0).alias("_"), *keys))
    for c, some in by_column(ranked).items():
        values = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.struct(F.lit(0).alias("_"), *keys).alias("cell"), F.col(f"`{c}`").cast("double").alias("value")).agg(F.count("*").alias("n"))
        out = out.join(percentiles(values, {a.output: share(a) for a in some}), "cell", "left")
    return out.select(*by, *(a.output for a in aggregates))
