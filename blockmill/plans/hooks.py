"""Commands around a job, and small files of facts about data.

A metafile holds `key=value` lines. Commands are texts: METAFILE READ path, METAFILE WRITE path key value …, METAFILE UPDATE
path key value … (other keys stay), HDFS RENAME from to, HDFS DELETE path.
"""

from __future__ import annotations

import shlex

from pyspark.sql import SparkSession

from ..operators.blocks import read_text, write_text
from ..sources import paths
from ..types import SchemaError


def read(spark: SparkSession, path: str) -> dict[str, str]:
    """What the metafile says; nothing if it isn't there."""
    if not paths.exists(spark, path):
        return {}
    pairs = (line.partition("=") for line in read_text(spark, path).splitlines() if "=" in line and not line.startswith("#"))
    return {k.strip(): v.strip() for k, _, v in pairs}


def write(spark: SparkSession, path: str, facts: dict[str, str]) -> None:
    write_text(spark, path, "".join(f"{k}={v}\n" for k, v in sorted(facts.items())))


def update(spark: SparkSession, path: str, facts: dict[str, str]) -> None:
    write(spark, path, {**read(spark, path), **facts})


def run(spark: SparkSession, commands: list[str]) -> list[dict[str, str]]:
    """Runs commands in order, and returns what METAFILE READ found. An unknown command, or a failure, raises."""
    found = []
    for text in commands:
        command, what, *args = [*shlex.split(text), "", ""][: max(2, len(shlex.split(text)))]
        kind = f"{command} {what}".upper()
        if kind == "METAFILE READ" and len(args) == 1:
            found.append(read(spark, args[0]))
        elif kind in ("METAFILE WRITE", "METAFILE UPDATE") and len(args) >= 3 and len(args) % 2:
            (write if kind.endswith("WRITE") else update)(spark, args[0], dict(zip(args[1::2], args[2::2], strict=True)))
        elif kind == "HDFS RENAME" and len(args) == 2:
            paths.move(spark, *args)
        elif kind == "HDFS DELETE" and len(args) == 1:
            paths.remove(spark, args[0])
        else:
            raise SchemaError(f"no command {text}")
    return found
