"""A session with the settings that the engine likes. None of its operators needs them for right results."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "blockmill", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    b = b.master(master) if master else b
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
