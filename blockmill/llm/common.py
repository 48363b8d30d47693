"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir
from ..sources.paths import remove

__all__ = ["Scratch", "components", "id_hash", "largest", "lists", "offsets", "remove", "roots", "shared_dir", "slices", "starts_of_runs", "table", "texts_of", "whole_runs"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(column: str) -> "F.Column":
    """crc32 of the id as text, the hash that the hold-out rules are given in."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about most_bytes of the column, one row at least; bounds what vectorised steps hold at once."""
    sizes = np.cumsum(np.diff(offsets(batch.column(column))))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def whole_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(k[1:] != k[:-1])
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def starts_of_runs(keys: np.ndarray) -> np.ndarray:
    """Indexes where a new run begins, and the end."""
    if len(keys) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def largest(counts: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of (key, n) of the largest n, at most about `most`: whole bins of n, and a share by hash of the next one.

    The least n comes from a histogram, so that no task gathers the largest rows of all others.
    """
    binned = counts.withColumn("_bin", F.floor(F.log2("n") * 16).cast("int"))
    least, part, share, left = 1 << 30, -1, 0, most
    for r in sorted(binned.groupBy("_bin").count().collect(), key=lambda r: -r["_bin"]):
        if r["count"] > left:
            part, share = r["_bin"], int(0.95 * left / r["count"] * (1 << 20))
            break
        least, left = r["_bin"], left - r["count"]
    drawn = (F.col("_bin") == part) & (F.pmod(F.xxhash64(key, F.lit("cut")), F.lit(1 << 20)) < share)
    return binned.where((F.col("_bin") >= least) | drawn).drop("_bin")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indexes over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    while True:
        new = label[label]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of the links (a, b) of longs.

    Alternates the large-star and small-star steps of distributed connected components. Each step is an aggregate of
    least neighbours and an equi-join, so that no neighbourhood is gathered anywhere. edges should be cheap to read twice.
    """
    now = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
    step = 0
    while True:
        both = now.union(now.select("b", "a"))
        # written, so that the join with it can split the links of a node that has many
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least-{step}")
        large = scratch.write(both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b"), f"{name}-large-{step}")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").selectExpr("b AS a", "m AS b").where("a <> b").union(down.selectExpr("a", "m AS b")).distinct()
        new = scratch.write(small, f"{name}-{step}")
        # done when every node has one link, to a node that has none
        ends = new.selectExpr("a AS node", "1 AS up", "0 AS down").union(new.selectExpr("b AS node", "0 AS up", "1 AS down"))
        unsettled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0]
        scratch.drop(f"{name}-least-{step}", f"{name}-large-{step}", *([f"{name}-{step - 1}"] if step else []))
        if not unsettled:
            return new.selectExpr("a AS node", "b AS label").union(new.selectExpr("b AS node", "b AS label").distinct())
        now, step = new, step + 1
