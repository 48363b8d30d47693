"""Dictionaries of texts and their codes: (colname, colvalue, code), codes from 1 for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import SchemaError
from .rows import need, number

SCHEMA = "colname string, colvalue string, code int"


def inline(spark: SparkSession, columns: dict[str, list[str]]) -> DataFrame:
    """Codes are positions, from 1."""
    return spark.createDataFrame([(c, v, k) for c, values in columns.items() for k, v in enumerate(values, 1)], SCHEMA)


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    need(df, columns)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("colname"), F.col(c).cast("string").alias("colvalue")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.*").where("colvalue IS NOT NULL").distinct()


def _numbered(values: DataFrame) -> DataFrame:
    """(colname, colvalue, _k): 1, 2, … in the order of each column's values. No task holds all values of a column."""
    placed = number(values, ["colname", "colvalue"], "_at")
    before = placed.groupBy("colname").agg((F.min("_at") - 1).alias("_before"))
    return placed.join(F.broadcast(before), "colname").select("colname", "colvalue", (F.col("_at") - F.col("_before")).cast("int").alias("_k"))


def build(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes in order of the values."""
    return _numbered(_values(df, columns)).withColumnRenamed("_k", "code")


def refresh(df: DataFrame, columns: list[str], old: DataFrame) -> DataFrame:
    """Old codes stay; new values get codes after the largest of their column."""
    new = _values(df, columns).join(old, ["colname", "colvalue"], "left_anti")
    last = old.groupBy("colname").agg(F.max("code").alias("_last"))
    added = _numbered(new).join(F.broadcast(last), "colname", "left").select("colname", "colvalue", (F.coalesce("_last", F.lit(0)) + F.col("_k")).alias("code"))
    return old.select("colname", "colvalue", "code").unionByName(added)


def encode(df: DataFrame, columns: list[str], dictionary: DataFrame, nulls_as: int | None = None, unknowns_as: int | None = None) -> DataFrame:
    """Texts to codes in place. Nulls and unknown values raise unless a code is given for them."""
    return _coded(df, columns, dictionary, "colvalue", "code", "int", nulls_as, unknowns_as, strict_nulls=True)


def decode(df: DataFrame, columns: list[str], dictionary: DataFrame, unknowns_as: str | None = None) -> DataFrame:
    """Codes to texts in place. Nulls stay; unknown codes raise unless a text is given for them."""
    return _coded(df, columns, dictionary, "code", "colvalue", "string", None, unknowns_as, strict_nulls=False)


def _coded(df, columns, dictionary, source, target, kind, nulls_as, unknowns_as, strict_nulls):
    need(df, columns)

    def one(df: DataFrame, c: str) -> DataFrame:
        d = dictionary.where(F.col("colname") == c).select(F.col(source).alias("_key"), F.col(target).alias("_value"), F.lit(True).alias("_known"))
        out = df.join(d, F.col(f"`{c}`").cast(dict(d.dtypes)["_key"]) == F.col("_key"), "left")
        key = F.col(f"`{c}`")
        null = F.lit(nulls_as).cast(kind) if nulls_as is not None else F.raise_error(F.lit(f"null in {c}")).cast(kind) if strict_nulls else F.lit(None).cast(kind)
        unknown = F.lit(unknowns_as).cast(kind) if unknowns_as is not None else F.raise_error(F.concat(F.lit(f"{c} has a value that the dictionary lacks: "), key.cast("string"))).cast(kind)
        return out.select(*(F.when(key.isNull(), null).when(F.col("_known").isNull(), unknown).otherwise(F.col("_value")).alias(c) if x == c else F.col(f"`{x}`") for x in df.columns))

    if len(set(columns)) != len(columns):
        raise SchemaError("a column is named twice")
    return reduce(one, columns, df)
