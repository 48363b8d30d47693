"""Cube aggregates that users write as a class with a buffer.

The contract, called for the rows of a cell in order of the inner keys: `setup(columns)` once, then for each row
`process(row)` and `aggregate(buffer)`, after the last row of each inner key `end_measure(buffer)`, and at the end
`output(buffer)`, of the type that `output_type` names. `buffer()` makes an empty one. A class that has
`merge(into, other)` as well is folded in parts, each of whole inner keys, so that no cell is in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_buffered(user) -> bool:
    return isinstance(user, type) and hasattr(user, "end_measure")


def fold(df: DataFrame, dims: list[str], sets: list[tuple[str, ...]], inner: list[str], columns: tuple[str, ...], user: type, name: str) -> DataFrame:
    """(dims, _gid, name) for each cell of each grouping set; _gid is Spark's grouping id."""
    kinds = {d: df.schema[d].dataType for d in dims}
    cells = [F.struct(F.lit(sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in s)).cast("long").alias("_gid"), *((F.col(f"`{d}`") if d in s else F.lit(None).cast(kinds[d])).alias(f"d{k}") for k, d in enumerate(dims))) for s in sets]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if hasattr(user, "merge") else 1
    keys = [F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(inner)]
    rows = df.select(F.explode(F.array(*cells)).alias("cell"), *keys, *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    rows = rows.select("cell.*", F.pmod(F.hash(*(f"i{k}" for k in range(len(inner)))), F.lit(parts)).alias("_part") if inner else F.lit(0).alias("_part"), *(c for c in rows.columns if c != "cell"))
    by = ["_gid", *(f"d{k}" for k in range(len(dims)))]
    n_inner, n_columns = len(inner), len(columns)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        one = user()
        one.setup(list(columns))
        buffer, last = one.buffer(), None
        order = [f"i{k}" for k in range(n_inner)]
        pdf = pdf.sort_values(order, kind="stable") if order else pdf
        plain = pdf[[*order, *(f"c{k}" for k in range(n_columns))]].astype(object)
        plain = plain.where(plain.notna(), None)
        for row in plain.itertuples(index=False, name=None):
            key = row[:n_inner]
            if last is not None and key != last:
                one.end_measure(buffer)
            one.process(row[n_inner:])
            one.aggregate(buffer)
            last = key
        one.end_measure(buffer)
        return pdf[by].iloc[:1].assign(buffer=[cloudpickle.dumps(buffer)])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        one = user()
        one.setup(list(columns))
        buffer, *others = (cloudpickle.loads(b) for b in pdf["buffer"])
        for other in others:
            one.merge(buffer, other)
        return pdf[by].iloc[:1].assign(value=[one.output(buffer)])

    held = T.StructType([rows.schema[c] for c in by] + [T.StructField("buffer", T.BinaryType())])
    buffers = rows.groupBy(*by, "_part").applyInPandas(part, held)
    out = T.StructType([rows.schema[c] for c in by]).add("value", T._parse_datatype_string(user.output_type) if isinstance(user.output_type, str) else user.output_type)
    return buffers.groupBy(*by).applyInPandas(whole, out).select(*(F.col(f"d{k}").alias(d) for k, d in enumerate(dims)), "_gid", F.col("value").alias(name))
