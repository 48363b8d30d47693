"""Summary views that follow a stream of facts: each micro-batch sets the bits of its days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.summary import DAYS


def follow(facts: DataFrame, dims: list[str], member: str, day: str, horizon: date, target: str, checkpoint: str) -> StreamingQuery:
    """Writes (dims, member, bitmap) increments as Parquet, exactly once for each micro-batch; `bitmaps` folds them by OR."""
    d = F.datediff(F.col(day).cast("date"), F.lit(horizon))
    bits = facts.where(d.between(0, DAYS - 1)).select(*dims, member, F.call_function("shiftleft", F.lit(1), d).alias("bitmap"))

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*dims, member).agg(F.bit_or("bitmap").alias("bitmap")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return bits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bitmaps(spark, target: str, dims: list[str], member: str) -> DataFrame:
    return spark.read.parquet(target).groupBy(*dims, member).agg(F.bit_or("bitmap").alias("bitmap"))
