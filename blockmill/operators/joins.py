"""Equi-joins. Keys are null-safe: a null key meets a null key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import SchemaError, wider
from .rows import need

HOW = {"": "inner", "INNER": "inner", "LEFT OUTER": "left", "RIGHT OUTER": "right", "FULL OUTER": "full"}


def _how(kind: str) -> str:
    kind = " ".join((kind or "").upper().split())
    if kind not in HOW:
        raise SchemaError(f"no join {kind}")
    return HOW[kind]


def _named(left: DataFrame, lname: str, lkeys: list[str], right: DataFrame, rname: str, rkeys: list[str], kind: str, hint: str | None, whole: bool = False) -> DataFrame:
    """whole: the keys are joined as one packed value, as blocks are dealt by."""
    need(left, lkeys)
    need(right, rkeys)
    if len(lkeys) != len(rkeys):
        raise SchemaError("a join needs as many keys on either side")
    for a, b in zip(lkeys, rkeys, strict=True):
        if wider(left.schema[a].dataType, right.schema[b].dataType) is None:
            raise SchemaError(f"types of {a} and {b} don't meet")
    left = left.select(*(F.col(f"`{c}`").alias(f"{lname}___{c}") for c in left.columns))
    right = right.select(*(F.col(f"`{c}`").alias(f"{rname}___{c}") for c in right.columns))
    if whole:
        one, two = (F.struct(*(side[f"{name}___{k}"].alias(f"k{i}") for i, k in enumerate(keys))) for side, name, keys in ((left, lname, lkeys), (right, rname, rkeys)))
        on = [one == two]
    else:
        on = [left[f"{lname}___{a}"].eqNullSafe(right[f"{rname}___{b}"]) for a, b in zip(lkeys, rkeys, strict=True)]
    return left.join(right.hint(hint) if hint else right, on, _how(kind))


def hash_join(left: DataFrame, lname: str, lkeys: list[str], right: DataFrame, rname: str, rkeys: list[str], kind: str = "") -> DataFrame:
    """The right side is built into a hash table, the left one probes it; columns are left___x and right___x.

    Spark sends the right side to every task where its size is below spark.sql.autoBroadcastJoinThreshold, and else deals
    both sides by key and builds tables from the right one's parts.
    """
    return _named(left, lname, lkeys, right, rname, rkeys, kind, "shuffle_hash" if _bytes(right) > _threshold(right) else None)


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _threshold(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    return int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)) if not text.lstrip("-").isdigit() else int(text)


def merge_join(left: DataFrame, lname: str, lkeys: list[str], right: DataFrame, rname: str, rkeys: list[str], kind: str = "", whole: bool = False) -> DataFrame:
    """A sort-merge join; columns are left___x and right___x."""
    return _named(left, lname, lkeys, right, rname, rkeys, kind, "merge", whole)


def reduce_join(fact: DataFrame, dimension: DataFrame, keys: list[str], kind: str = "", unique: bool = True) -> DataFrame:
    """Keys, the fact's other columns, the dimension's other columns. A key that the dimension has twice raises (unique)."""
    need(fact, keys)
    need(dimension, keys)
    how = _how(kind)
    if how not in ("inner", "left"):
        raise SchemaError("a fact-to-dimension join is inner or left outer")
    for k in keys:
        if fact.schema[k].dataType != dimension.schema[k].dataType:
            raise SchemaError(f"types of {k} differ")
    other = [c for c in fact.columns if c not in keys]
    more = [c for c in dimension.columns if c not in keys]
    if both := set(other) & set(more):
        raise SchemaError(f"both sides have {', '.join(sorted(both))}")
    if unique:  # the aggregate deals the dimension by the keys that the join needs it dealt by
        packed = F.struct(*(F.col(c) for c in more)) if more else F.lit(1)
        told = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
        once = dimension.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(packed).alias("_v"))
        value = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("the dimension has more than one row for "), told)).cast(once.schema["_v"].dataType)).otherwise(F.col("_v"))
        once = once.withColumn("_v", value)
        dimension = once.select(*keys, *(F.col("_v").getField(c).alias(c) for c in more)) if more else once.where(F.col("_v").isNotNull()).select(*keys)
    right = dimension.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *more)
    on = [fact[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return fact.join(right, on, how).select(*keys, *other, *more)
