"""Cube aggregates that users write in pandas and that take a cell in pieces, so that no task holds a cell.

The contract, of a class: `buffer()` makes an empty buffer, `take(buffer, *series)` folds some of a cell's rows into it, a
Series for each column, `merge(into, other)` folds another buffer into one, and `output(buffer)` gives the value, of the type
that `output_type` names. The pieces have any size and order, so that the value may depend on neither. Buffers are to be small.

A task keeps a buffer for each of the finest cells, CELLS at most: then they are merged into the cells of all sets and sent
on. These are sorted by cell, and merged as they come by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .rows import need

#: Finest cells that a task holds.
CELLS = 1 << 14


def is_pieced(user) -> bool:
    return isinstance(user, type) and hasattr(user, "take") and hasattr(user, "merge")


def fold_pieces(df: DataFrame, dims: list[str], sets: list[tuple[str, ...]], columns: tuple[str, ...], user: type, name: str) -> DataFrame:
    """(dims, _gid, name) for each cell of each grouping set; _gid is Spark's grouping id."""
    need(df, list(columns))
    by = ["_gid", *(f"d{k}" for k in range(len(dims)))]
    kept = [(sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in s), [d in s for d in dims]) for s in sets]
    rows = df.select(F.lit(0).cast("long").alias("_gid"), *(F.col(f"`{d}`").alias(f"d{k}") for k, d in enumerate(dims)), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    cells = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in by])
    kinds = [to_arrow_type(f.dataType) for f in cells]
    value = T._parse_datatype_string(user.output_type) if isinstance(user.output_type, str) else user.output_type
    n_columns, most, made = len(columns), CELLS, to_arrow_type(value)

    def record(found: list[tuple], last: pa.Array, called: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([c[k] for c in found], t) for k, t in enumerate(kinds)), last], [*by, called])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, held = user(), {}

        def sent() -> pa.RecordBatch:
            out = {}
            for cell, buffer in held.items():
                packed = cloudpickle.dumps(buffer)
                for gid, there in kept:
                    key = (gid, *(v if t else None for v, t in zip(cell, there, strict=True)))
                    if key in out:
                        one.merge(out[key], cloudpickle.loads(packed))
                    else:
                        out[key] = cloudpickle.loads(packed)
            held.clear()
            return record(list(out), pa.array([cloudpickle.dumps(b) for b in out.values()], pa.binary()), "buffer")

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, np.int64)
            for c in by[1:]:  # made dense each time, so that many dimensions don't overflow
                coded = batch.column(c).dictionary_encode("encode")
                codes = np.unique(codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            starts = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), batch.num_rows)
            firsts = batch.select(by[1:]).take(pa.array(order[starts[:-1]])) if dims else None
            found = list(zip(*(firsts.column(c).to_pylist() for c in by[1:]), strict=True)) if dims else [()]
            series = [batch.column(f"c{k}").take(pa.array(order)).to_pandas() for k in range(n_columns)]
            for cell, a, b in zip(found, starts[:-1], starts[1:], strict=True):
                if cell not in held:
                    if len(held) >= most:
                        yield sent()
                    held[cell] = one.buffer()
                one.take(held[cell], *(s.iloc[a:b].reset_index(drop=True) for s in series))
        if held:
            yield sent()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, cell, buffer = user(), None, None
        for batch in batches:
            found, values = [], []
            for key, packed in zip(zip(*(batch.column(c).to_pylist() for c in by), strict=True), batch.column("buffer"), strict=True):
                other = cloudpickle.loads(packed.as_py())
                if key == cell:
                    one.merge(buffer, other)
                    continue
                if cell is not None:
                    found.append(cell)
                    values.append(one.output(buffer))
                cell, buffer = key, other
            if found:
                yield record(found, pa.array(values, made, from_pandas=True), "value")
        if cell is not None:
            yield record([cell], pa.array([one.output(buffer)], made, from_pandas=True), "value")

    buffers = rows.mapInArrow(part, T.StructType([*cells, T.StructField("buffer", T.BinaryType())]))
    merged = buffers.repartition(*by).sortWithinPartitions(*by).mapInArrow(whole, T.StructType([*cells, T.StructField("value", value)]))
    return merged.select(*(F.col(f"d{k}").alias(d) for k, d in enumerate(dims)), "_gid", F.col("value").alias(name))
