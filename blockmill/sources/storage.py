"""Formats that relations are read from and written to."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import blocks
from ..types import SchemaError, parse_schema


@dataclass(frozen=True)
class Storage:
    read: Callable[[SparkSession, list[str], dict[str, str]], DataFrame]
    write: Callable[[DataFrame, str, dict[str, str], bool], None]


#: Types that text files hold; values of others are null.
TEXT_TYPES = (T.IntegerType, T.LongType, T.StringType, T.DoubleType, T.FloatType)


def read_text(spark: SparkSession, paths: list[str], params: dict[str, str]) -> DataFrame:
    """Lines split by a separator (a regular expression, tab by default). Empty and missing fields are null, extra ones ignored."""
    if "schema" not in params:
        raise SchemaError("TEXT needs a schema")
    schema = parse_schema(params["schema"])
    cells = F.split("value", params.get("separator", "\t"), -1)

    def cell(i: int, t: T.DataType):
        if not isinstance(t, TEXT_TYPES):
            return F.lit(None).cast(t)
        x = F.get(cells, F.lit(i))
        x = F.when(x != "", x)
        return x if isinstance(t, T.StringType) else x.try_cast(t)

    return spark.read.text(paths).select(*(cell(i, f.dataType).alias(f.name) for i, f in enumerate(schema)))


def write_text(df: DataFrame, path: str, params: dict[str, str], overwrite: bool) -> None:
    """A line for each row; nulls are empty fields."""
    separator = params.get("separator", "\t")
    if len(separator.encode()) != 1:
        raise SchemaError("the separator of text files is one byte")
    cells = [F.coalesce((F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string")), F.lit("")) for f in df.schema]
    df.select(F.concat_ws(separator, *cells).alias("value")).write.mode(_mode(overwrite)).text(path)


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def _options(params: dict[str, str]) -> dict[str, str]:
    known = {"ignore_bad_files": "ignoreCorruptFiles", "multiple_schemas": "mergeSchema"}
    return {known.get(k, k): v for k, v in params.items() if k not in ("schema", "unsplittable", "overwrite")}


def _files(fmt: str) -> Storage:
    def read(spark: SparkSession, paths: list[str], params: dict[str, str]) -> DataFrame:
        reader = spark.read.options(**_options(params))
        return (reader.schema(parse_schema(params["schema"])) if "schema" in params else reader).format(fmt).load(paths)

    def write(df: DataFrame, path: str, params: dict[str, str], overwrite: bool) -> None:
        df.write.mode(_mode(overwrite)).options(**_options(params)).format(fmt).save(path)

    return Storage(read, write)


def _avro() -> Storage:
    plain = _files("avro")

    def guarded(f):
        def call(*args):
            try:
                return f(*args)
            except Exception as e:
                if "Failed to find data source: avro" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e):
                    raise SchemaError("this Spark has no Avro data source: add the spark-avro package, or use PARQUET") from e
                raise

        return call

    return Storage(guarded(plain.read), guarded(plain.write))


def read_virtual(spark: SparkSession, paths: list[str], params: dict[str, str]) -> DataFrame:
    """A row for each of `mappers` tasks, with the column dummy: drives operators that make rows themselves."""
    n = int(params.get("mappers", "1"))
    return spark.range(0, n, 1, n).select(F.col("id").alias("dummy"))


def _no_write(name: str):
    def write(df: DataFrame, path: str, params: dict[str, str], overwrite: bool) -> None:
        raise SchemaError(f"{name} can't be written")

    return write


def read_blocks(spark: SparkSession, paths: list[str], params: dict[str, str]) -> DataFrame:
    out = blocks.load(spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(blocks.load(spark, p))
    return out


def write_blocks(df: DataFrame, path: str, params: dict[str, str], overwrite: bool) -> None:
    keys = [k for k in re.split(r"\s*,\s*", params.get("partition_keys", "")) if k]
    if not keys:
        raise SchemaError("only relations that passed BLOCKGEN can be stored as blocks")
    order = [k for k in re.split(r"\s*,\s*", params.get("sort_keys", "")) if k]
    blocks.save(df, path, keys, order, int(params.get("buckets", "8")), params.get("blockgen_id", ""), overwrite)


STORAGES: dict[str, Storage] = {
    "TEXT": Storage(read_text, write_text),
    "PARQUET": _files("parquet"),
    "ORC": _files("orc"),
    "JSON": _files("json"),
    "AVRO": _avro(),
    "BLOCKS": Storage(read_blocks, write_blocks),
    "VIRTUAL": Storage(read_virtual, _no_write("VIRTUAL")),
}


def storage(name: str, more: dict[str, Storage] | None = None) -> Storage:
    if more and name in more:
        return more[name]
    if name.upper() in STORAGES:
        return STORAGES[name.upper()]
    if "." in name:
        from ..functions.registry import load

        made = load(name)
        return made() if isinstance(made, type) else made
    raise SchemaError(f"unknown format {name}")
