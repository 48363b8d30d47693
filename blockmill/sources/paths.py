"""Paths of inputs and outputs, by any of Hadoop's file systems: globs, latest versions, dated folders, and chores."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import SparkSession

from ..types import SchemaError

LATEST = "#LATEST"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def glob(spark: SparkSession, pattern: str) -> list[str]:
    where, fs = _at(spark, pattern)
    found = fs.globStatus(where)
    return sorted(str(s.getPath().toString()) for s in found) if found is not None else []


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return bool(fs.exists(where))


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether the file, or the first of the folder that holds data, begins as Parquet files do."""
    where, fs = _at(spark, path)
    files = [where] if fs.getFileStatus(where).isFile() else sorted((s.getPath() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=str)
    if not files:
        return False
    stream = fs.open(files[0])
    try:
        return [stream.read() for _ in range(4)] == list(b"PAR1")
    finally:
        stream.close()


def resolve(spark: SparkSession, path: str) -> str:
    """#LATEST stands for the lexically greatest name at its place."""
    while LATEST in path:
        head, tail = path.split(LATEST, 1)
        stop = tail.find("/")
        part, rest = (tail, "") if stop < 0 else (tail[:stop], tail[stop:])
        found = glob(spark, f"{head}*{part}")
        if not found:
            raise SchemaError(f"nothing matches {path}")
        path = found[-1] + rest
    return path


def dated(spark: SparkSession, root: str, start: int, end: int, error_on_missing: bool = False, hourly_for_missing_daily: bool = False) -> list[str]:
    """Folders root/daily/yyyy/MM/dd for yyyyMMdd, root/hourly/yyyy/MM/dd/HH for yyyyMMddHH, newest first, those that are there."""
    hourly = len(str(start)) == 10
    if len(str(start)) != len(str(end)) or len(str(start)) not in (8, 10):
        raise SchemaError("a dated path goes from and to yyyyMMdd, or yyyyMMddHH")
    form = "%Y%m%d%H" if hourly else "%Y%m%d"
    first, last = datetime.strptime(str(start), form), datetime.strptime(str(end), form)
    if last < first:
        raise SchemaError("a dated path ends before it starts")
    step, out = timedelta(hours=1) if hourly else timedelta(days=1), []
    now = last
    while now >= first:
        path = f"{root}/hourly/{now:%Y/%m/%d/%H}" if hourly else f"{root}/daily/{now:%Y/%m/%d}"
        if exists(spark, path):
            out.append(path)
        else:
            hours = [p for h in range(23, -1, -1) if exists(spark, p := f"{root}/hourly/{now:%Y/%m/%d}/{h:02d}")] if hourly_for_missing_daily and not hourly else []
            if not hours and error_on_missing:
                raise SchemaError(f"missing: {path}")
            out += hours
        now -= step
    if not out:
        raise SchemaError(f"no input below {root} from {start} to {end}")
    return out


def days(start: date, end: date) -> list[date]:
    return [start + timedelta(days=k) for k in range((end - start).days + 1)]


def remove(spark: SparkSession, path: str) -> bool:
    """Whether it was there."""
    where, fs = _at(spark, path)
    return bool(fs.delete(where, True))


def move(spark: SparkSession, source: str, target: str) -> bool:
    a, fs = _at(spark, source)
    b, _ = _at(spark, target)
    return bool(fs.rename(a, b))


def make(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return bool(fs.mkdirs(where))


def listing(spark: SparkSession, folder: str):
    """(path, length, modified) of the files below the folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
