"""Tables between steps, as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .sources.paths import remove

_LIVE: list[Scratch] = []
_SCOPE: ContextVar[tuple[list[Scratch], bool] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``, or the context's checkpoint folder. Only where neither is set and the
    session runs in one process (as in tests) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="blockmill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; what is left of them goes on `release`, or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _LIVE.append(self)
        if (scope_ := _SCOPE.get()) is not None:
            scope_[0].append(self)

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """The table as it is read back. by: columns whose values are folders, so that a filter on them reads its folders alone."""
        if (scope_ := _SCOPE.get()) is not None and scope_[1]:
            return self.spark.createDataFrame([], df.schema)
        path = f"{self.root}/{name}"
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")

    def end(self) -> None:
        if self in _LIVE:
            _LIVE.remove(self)
            remove(self.spark, self.root)


@contextmanager
def scope(dry: bool = False) -> Iterator[None]:
    """Tables that are made inside go at its end. dry: none is written, and all are empty, for what asks for schemas alone."""
    made: list[Scratch] = []
    token = _SCOPE.set((made, dry))
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for s in made:
            s.end()


def release() -> None:
    """Removes all tables between steps. DataFrames that read them are of no use afterwards: call it when results are stored."""
    while _LIVE:
        _LIVE[-1].end()


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the session may have ended first
        pass
