"""Blocks: co-partitioned, sorted units of rows with an id, so that later joins and cubes need no shuffle.

A row's bucket is its partition keys' hash modulo the number of buckets, and rows are dealt by the keys, so that partition k
holds bucket k. Within a bucket, in order of the keys, a block ends at the first change of key once it has enough rows,
bytes or keys. Only the keys' counts are walked to find those places; rows get their block ids by a join on the keys, for
which they lie right already, and relations of one layout are joined by their keys without another exchange.

Keys are packed in a struct where rows are dealt and joined: its hash is the keys' hash, and null keys are equal in it, so
that Spark knows two relations that were dealt by it to lie alike.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SchemaError, parse_schema, show_schema
from .rows import need

BLOCK, BUCKET = "_block_id", "_bucket"
META = "_blocks.json"
#: Bytes of a bucket, about, and buckets at most.
BUCKET_BYTES, BUCKETS_MOST = 256 << 20, 1 << 17
KINDS = ("ROW", "SIZE", "PARTITION_KEY")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.hash(*(F.col(k) for k in keys)), F.lit(buckets))


def width(schema: T.StructType) -> Column:
    """Bytes of a row, about: fixed widths, and the lengths of texts."""
    fixed = {T.ByteType: 1, T.BooleanType: 1, T.IntegerType: 4, T.FloatType: 4}
    out = F.lit(0).cast("long")
    for f in schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 2
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
        else:
            out = out + fixed.get(type(f.dataType), 8)
    return out


def packed(keys: list[str]) -> Column:
    """The keys as one value, whatever their names."""
    return F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))


def buckets_for(df: DataFrame) -> int:
    """Buckets of about BUCKET_BYTES of what df is read from, as many as Spark deals a shuffle to at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(BUCKETS_MOST, -(-size // BUCKET_BYTES)))


def blockgen(df: DataFrame, kind: str, n: int, keys: list[str], order: list[str] = (), buckets: int | None = None, distinct: bool = False) -> DataFrame:
    """df with _block_id, dealt by the keys and sorted by block, keys and order. kind: ROW, SIZE (bytes) or PARTITION_KEY.

    buckets: by default as many as the size of the input asks for. All rows of a key are in one block, and so in one task.
    """
    kind = kind.upper()
    if kind not in KINDS:
        raise SchemaError(f"no blocks by {kind}")
    need(df, [*keys, *order])
    buckets = buckets or buckets_for(df)
    df = df.distinct() if distinct else df
    cost = {"ROW": F.count("*"), "SIZE": F.sum(width(df.schema)), "PARTITION_KEY": F.lit(1).cast("long")}[kind]
    counts = df.groupBy(packed(keys).alias("_k")).agg(cost.alias("_cost")).withColumn(BUCKET, F.pmod(F.hash("_k"), F.lit(buckets)))
    # a bucket in each partition, in order of the keys
    walked = counts.repartitionById(buckets, F.col(BUCKET)).sortWithinPartitions(BUCKET, "_k").mapInArrow(_cutter(n), T.StructType([counts.schema["_k"], T.StructField(BLOCK, T.LongType())]))
    return _laid(_with(df, keys, walked.repartition(buckets, "_k"), buckets), keys, order)


def _with(df: DataFrame, keys: list[str], ids: DataFrame, buckets: int) -> DataFrame:
    """df dealt by the keys, with the block id of its key.

    A join's sides are dealt anew where Spark wants more partitions than there are buckets: only the exchange above it holds
    a bucket in one partition. It costs nothing where the join keeps the deal, as Spark then leaves it out.
    """
    rows = df.repartition(buckets, packed(keys))
    return rows.join(ids, packed(keys) == F.col("_k")).drop("_k").repartition(buckets, packed(keys))


def _laid(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.sortWithinPartitions(BLOCK, *(F.col(c).asc_nulls_first() for c in dict.fromkeys([*keys, *(order or keys)])))


def _cutter(n: int):
    """Numbers the blocks of each bucket: keys come in order with their costs, and a block ends with the key that fills it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, cost = None, 0, 0
        for batch in batches:
            of, costs = batch.column(BUCKET).to_numpy(), batch.column("_cost").to_numpy()
            out = np.empty(batch.num_rows, np.int64)
            ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, batch.num_rows) if batch.num_rows else []
            at = 0
            for end in map(int, ends):
                if of[at] != bucket:
                    bucket, number, cost = of[at], 0, 0
                upto, base = cost + np.cumsum(costs[at:end]), 0
                first = at
                while at < end:  # a step for each block
                    stop = first + int(np.searchsorted(upto, base + n)) + 1
                    out[at:stop] = (int(bucket) << 32) + number
                    if stop > end:
                        cost = int(upto[-1]) - base
                        break
                    at, base, number, cost = stop, int(upto[stop - 1 - first]), number + 1, 0
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(out)], ["_k", BLOCK])

    return cut


@dataclass
class Meta:
    """What a block store knows of itself."""

    schema: str
    partition_keys: list[str]
    sort_keys: list[str]
    buckets: int
    blockgen_id: str
    version: str


def boundaries(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(bucket, block id, least keys) of each block."""
    packed = F.struct(*(F.col(k) for k in keys))
    return blocks.groupBy(BLOCK).agg(F.min(packed).alias("_first"), F.count("*").alias("_rows")).select(F.shiftright(BLOCK, 32).cast("int").alias(BUCKET), BLOCK, "_first", "_rows")


def blockgen_by_index(df: DataFrame, index: DataFrame, keys: list[str], order: list[str] = (), buckets: int = 8, index_keys: list[str] | None = None) -> DataFrame:
    """df dealt to the blocks of another relation (`boundaries` of it): each key goes to the block whose range holds it.

    buckets: those of the other relation. Keys before a bucket's first block go to that block; a bucket that the index lacks raises.
    """
    need(df, [*keys, *order])
    fields = index.schema["_first"].dataType.fields
    first = F.struct(*(F.col("_first").getField(f.name).cast(df.schema[k].dataType).alias(f"k{i}") for i, (f, k) in enumerate(zip(fields, keys, strict=True))))
    marks = index.select(F.col(BUCKET), F.col(BLOCK), first.alias("_k"), F.lit(0).alias("_data"))
    there = df.select(packed(keys).alias("_k")).distinct().select(F.pmod(F.hash("_k"), F.lit(buckets)).alias(BUCKET), F.lit(None).cast("long").alias(BLOCK), "_k", F.lit(1).alias("_data"))
    every = Window.partitionBy(BUCKET)
    upto = every.orderBy("_k", "_data").rowsBetween(Window.unboundedPreceding, 0)
    routed = marks.unionByName(there).select("_k", "_data", F.coalesce(F.last(BLOCK, ignorenulls=True).over(upto), F.min(BLOCK).over(every)).alias("_id")).where("_data = 1")
    lacking = F.raise_error(F.lit("the index has no block for a key's bucket")).cast("long")
    # the condition holds for all: it makes the check run where nothing else asks for the ids
    routed = routed.select("_k", F.when(F.col("_id").isNull(), lacking).otherwise(F.col("_id")).alias(BLOCK)).where(F.col(BLOCK) >= 0)
    return _laid(_with(df, keys, routed.repartition(buckets, "_k"), buckets), keys, order)


def matched_join(left: DataFrame, lname: str, lkeys: list[str], right: DataFrame, rname: str, rkeys: list[str], kind: str = "") -> DataFrame:
    """A merge join of two relations of one layout, by the keys that they were dealt by: neither side is dealt again.

    In one layout rows of equal keys are in blocks of equal ids, so that rows meet within blocks only. Other keys than those
    that the blocks were dealt by are joined as well, after another exchange.
    """
    from .joins import merge_join

    left, right = left.drop(BLOCK), right.drop(BLOCK)
    return merge_join(left, lname, lkeys, right, rname, rkeys, kind, whole=True)


def validate(blocks: DataFrame, keys: list[str], order: list[str] = (), buckets: int = 8, kind: str | None = None, n: int = 0) -> DataFrame:
    """(check, violations) for blocks as they lie in their partitions: bucket, one key in one block, key ranges apart, order."""
    rows = blocks.withColumn("_p", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    bucket = rows.where(F.shiftright(BLOCK, 32) != bucket_of(keys, buckets)).select(F.lit("bucket").alias("check"))
    split = rows.groupBy(*keys).agg(F.countDistinct(BLOCK).alias("n")).where("n > 1").select(F.lit("key in two blocks").alias("check"))
    packed = F.struct(*(F.col(k) for k in keys))
    ranges = rows.groupBy(BLOCK).agg(F.min(packed).alias("lo"), F.max(packed).alias("hi"), F.count("*").alias("rows"), F.countDistinct(packed).alias("keys")).withColumn("_b", F.shiftright(BLOCK, 32))
    by = Window.partitionBy("_b").orderBy(BLOCK)
    overlap = ranges.withColumn("last", F.lag("hi").over(by)).where("last >= lo").select(F.lit("key ranges overlap").alias("check"))
    sort = F.struct(*(F.col(c) for c in dict.fromkeys([*keys, *(order or keys)])))
    before = F.lag(sort).over(Window.partitionBy("_p", BLOCK).orderBy("_row"))
    unsorted = rows.withColumn("_last", before).withColumn("_now", sort).where("_last > _now").select(F.lit("order").alias("check"))
    parts = [bucket, split, overlap, unsorted]
    if kind in ("ROW", "PARTITION_KEY"):
        measure = "rows" if kind == "ROW" else "keys"
        more = Window.partitionBy("_b").orderBy(F.col(BLOCK).desc())
        parts.append(ranges.withColumn("_k", F.row_number().over(more)).where((F.col("_k") > 1) & (F.col(measure) < n)).select(F.lit("block too small").alias("check")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    names = ["bucket", "key in two blocks", "key ranges overlap", "order", *(["block too small"] if len(parts) > 4 else [])]
    every = blocks.sparkSession.createDataFrame([(x,) for x in names], "check string")
    return every.join(found.groupBy("check").agg(F.count("*").alias("violations")), "check", "left").select("check", F.coalesce("violations", F.lit(0)).alias("violations"))


# --- block store ----------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _fs(spark, path)
    size = fs.getFileStatus(where).getLen()
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))[:size].decode()
    finally:
        stream.close()


def save(blocks: DataFrame, path: str, keys: list[str], order: list[str] = (), buckets: int = 8, blockgen_id: str = "", overwrite: bool = False) -> None:
    """Blocks as Parquet, each in one file and in order, beside a metadata file and the blocks' boundaries.

    Rows are dealt by bucket as they are written, since blocks that were loaded or joined need not lie whole.
    Data and boundaries go to a folder of a new name, and the metadata, which names it, is written last: a store that is
    written over is the old one until then. Folders that no metadata names are removed afterwards.
    """
    if BLOCK not in blocks.columns:
        raise SchemaError("only blocks can be stored as blocks: use blockgen first")
    spark = blocks.sparkSession
    where, fs = _fs(spark, f"{path}/{META}")
    if fs.exists(where) and not overwrite:
        raise SchemaError(f"{path} holds blocks already")
    version = f"v-{uuid.uuid4().hex}"
    dealt = blocks.repartitionById(buckets, F.shiftright(BLOCK, 32).cast("int"))
    _laid(dealt, keys, order).write.parquet(f"{path}/{version}/data")
    stored = spark.read.schema(blocks.schema).parquet(f"{path}/{version}/data")
    boundaries(stored, keys).write.parquet(f"{path}/{version}/index")
    plain = T.StructType([f for f in blocks.schema if f.name != BLOCK])
    write_text(spark, f"{path}/{META}", json.dumps(asdict(Meta(show_schema(plain), list(keys), list(order or keys), buckets, blockgen_id or path, version))))
    for other in fs.listStatus(where.getParent()):
        name = other.getPath().getName()
        if name.startswith("v-") and name != version:
            fs.delete(other.getPath(), True)


def meta(spark: SparkSession, path: str) -> Meta:
    return Meta(**json.loads(read_text(spark, f"{path}/{META}")))


def load(spark: SparkSession, path: str) -> DataFrame:
    m = meta(spark, path)
    return spark.read.schema(T.StructType([*parse_schema(m.schema), T.StructField(BLOCK, T.LongType())])).parquet(f"{path}/{m.version}/data")


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{meta(spark, path).version}/index")


def load_matching(spark: SparkSession, path: str, relation: DataFrame) -> DataFrame:
    """The stored blocks whose ids the relation has; blocks without a match give no rows."""
    return load(spark, path).join(relation.select(BLOCK).distinct(), BLOCK, "left_semi")


def extract(spark: SparkSession, path: str, block: int) -> DataFrame:
    return load(spark, path).where(F.col(BLOCK) == block)


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int = 8, overwrite: bool = False) -> None:
    """A table bucketed and sorted by the keys: joins of tables with equal buckets need no shuffle."""
    df.repartition(buckets, *keys).write.mode("overwrite" if overwrite else "errorifexists").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
