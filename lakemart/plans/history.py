"""Versioned dimensions whose closed versions are written once: a load reads and writes current versions alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.operators import dimensions
from lakemart.sources import sinks
from lakemart.sources.scratch import cleared, written

CURRENT, CLOSED = "current", "closed"
#: So many parts of closed versions, one a load, are gathered into one by the next load.
PARTS = 32


def begin(first: DataFrame, path: str) -> sinks.Snapshot:
    """Publish a dimension with its versions as the first of a split history."""
    return sinks.publish_parts({CURRENT: first.where("is_current"), CLOSED: first.where("not is_current")}, path, 0)


def _closed(found: sinks.Snapshot) -> list[str]:
    """The folders of closed versions, those that have none left out."""
    return [*found.carried, *([f"{found.folder}/{CLOSED}"] if found.metrics[CLOSED] else [])]


def current_versions(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{sinks.snapshot(spark, path, number).folder}/{CURRENT}")


def all_versions(spark: SparkSession, path: str, business_key: str, type6: dict[str, str] | None = None, number: int | None = None) -> DataFrame:
    """Every version of every member. The columns of type6 {column: its source} are told here, so that a changed member's
    closed versions need no rewriting: the current version's value is joined to them by business key."""
    found = sinks.snapshot(spark, path, number)
    now = spark.read.parquet(f"{found.folder}/{CURRENT}")
    now = now.withColumns({c: F.col(origin).cast(now.schema[c].dataType) for c, origin in (type6 or {}).items()})
    if not (folders := _closed(found)):
        return now
    past = spark.read.schema(now.schema).parquet(*folders)
    if type6:
        told = now.select(business_key, F.struct(*type6).alias("_now"))
        past = past.join(told, business_key, "left").select(*[F.coalesce(f"_now.{c}", c).alias(c) if c in type6 else F.col(c) for c in now.columns])
    return now.unionByName(past)


def load(source: DataFrame, path: str, business_key: str, key: str, type2: Sequence[str], load_date: str, type1: Sequence[str] = (), type0: dict[str, str] | None = None, parts: int = PARTS) -> sinks.Snapshot:
    """Publish what scd2_merge makes of the last version and a source. Its metrics are the rows written: current versions, and those closed by this load.

    Only current versions are read: the greatest key is among them, as no version closes without a successor. Earlier
    closed parts are carried by name. Once there are `parts` of them they are gathered into one.
    """
    spark = source.sparkSession
    last = sinks.snapshot(spark, path)
    before = spark.read.parquet(f"{last.folder}/{CURRENT}")
    with cleared(spark):
        branches = written(dimensions.scd2_branches(before, source, business_key, key, type2, load_date, type1, type0), "branches")
        rows = dimensions.with_new_keys(branches, key, [business_key], before)
        carry, closed = _closed(last), branches.where("not is_current")  # what closes has its key
        if len(carry) >= parts:
            closed = reduce(DataFrame.unionByName, [closed, spark.read.schema(closed.schema).parquet(*carry)])
            carry = []
        return sinks.publish_parts({CURRENT: rows.where("is_current"), CLOSED: closed}, path, last.number, carry)
