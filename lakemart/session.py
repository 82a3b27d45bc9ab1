"""The session that the jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lakemart", **conf: str) -> SparkSession:
    """UTC, adaptive plans and dynamic overwrite; anything else, such as the master, comes from spark-submit or conf."""
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return SparkSession.builder.appName(name).config(map=fixed | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
