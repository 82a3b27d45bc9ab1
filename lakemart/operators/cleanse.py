"""Cleansing: normalising, conforming, rules, duplicates, rejects and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.functions.columns import Rule, normalized, reject_reason

# The one shape of events, and the columns that hold codes.
EVENT_COLUMNS = {
    "event_id": "string", "event_ts": "timestamp", "detector_type": "string", "detector_code": "string", "sensor_serial": "string",
    "camera_code": "string", "segment_code": "string", "direction": "string", "vehicle_type_code": "string", "speed_kmh": "decimal(5,1)",
    "headway_seconds": "decimal(6,2)", "occupancy_pct": "decimal(5,2)", "_ingest_ts": "timestamp", "_source_file": "string",
    "event_date": "date", "ingest_date": "date",
}
CODES = ("detector_code", "sensor_serial", "camera_code", "segment_code", "direction", "vehicle_type_code")


def normalize(df: DataFrame, columns: Sequence[str] = CODES) -> DataFrame:
    return df.withColumns({c: normalized(F.col(c)) for c in columns if c in df.columns})


def conformed(df: DataFrame, given: dict[str, Column], *more: str) -> DataFrame:
    """df in the one shape of events, and any further columns of its own; what a feed doesn't give is null."""
    return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()], *more)


def conform_sensor(df: DataFrame, *more: str) -> DataFrame:
    own = {c: F.col(c) for c in EVENT_COLUMNS if c in df.columns}
    return conformed(df, own | {"detector_type": F.lit("SENSOR"), "detector_code": F.col("sensor_serial")}, *more)


def conform_camera(df: DataFrame, *more: str) -> DataFrame:
    """The detection's fields lie in a struct; its event time was lifted when it was read."""
    own = {c: F.col(c) for c in ("event_id", "event_ts", "camera_code", "_ingest_ts", "_source_file", "event_date", "ingest_date")}
    inner = {"segment_code": "segment_code", "direction": "direction", "vehicle_type_code": "vehicle_class", "speed_kmh": "speed_kmh"}
    return conformed(df, own | {k: F.col(f"detection.{v}") for k, v in inner.items()} | {"detector_type": F.lit("CAMERA"), "detector_code": F.col("camera_code")}, *more)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    out, *rest = feeds
    for x in rest:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def labelled_union(parts: dict[str, DataFrame], name: str = "label") -> DataFrame:
    return union_feeds(*[x.select(F.lit(k).alias(name), "*") for k, x in parts.items()])


def split_corrupt(df: DataFrame, column: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(readable rows, lines that could not be read: no rule sees those). Of a bad line its parsed fields and the line itself stay."""
    bad = df.where(F.col(column).isNotNull()).withColumn("reject_reason", F.lit("CORRUPT_RECORD"))
    return df.where(F.col(column).isNull()).drop(column), bad


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(rules))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("reject_reason is null").drop("reject_reason"), df.where("reject_reason is not null")


def place_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_place", salts: int = 64) -> DataFrame:
    """df with each row's place among the rows of its key: 1 for the first in a total order, more for others.

    Rows that lack a key are one group, which may hold very many: these are ordered within salts first, and only the
    first of each salt meets the others.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    row = F.row_number()
    whole = df.where(known).withColumn(name, row.over(Window.partitionBy(*keys).orderBy(*order)))
    salted = df.where(~known).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    salted = salted.withColumn(name, row.over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    first = F.when(F.col(name) == 1, F.lit(-1).cast("long")).otherwise(F.col("_salt"))  # the rest stay in their salts
    placed = salted.withColumn("_met", first).withColumn("_among", row.over(Window.partitionBy(*keys, "_met").orderBy(*order)))
    return whole.unionByName(placed.withColumn(name, F.when(F.col("_met") == -1, F.col("_among")).otherwise(F.lit(2))).drop("_salt", "_met", "_among"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in a total order. Rows that lack a key are one group."""
    return place_in_group(df, keys, order).where("_place = 1").drop("_place")


def label_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column], reason: str = "DUPLICATE") -> DataFrame:
    """All rows but the first of each key are labelled, whatever reason they had. Rows that lack a key are one group."""
    placed = place_in_group(df, keys, order)
    return placed.withColumn("reject_reason", F.when(F.col("_place") > 1, reason).otherwise(F.col("reject_reason"))).drop("_place")


def event_order() -> list[Column]:
    return [F.desc_nulls_last("event_ts"), F.asc_nulls_last("_source_file"), F.asc_nulls_last("detector_code")]


def clean_weather(df: DataFrame) -> DataFrame:
    """Typed, upper-cased, one row per station and time; rows without a time are removed."""
    typed = df.select(
        normalized(F.col("station_code")).alias("station_code"), F.col("observed_ts").cast("timestamp").alias("observed_ts"), normalized(F.col("condition_code")).alias("condition_code"),
        F.col("temperature_c").cast("decimal(4,1)").alias("temperature_c"), F.col("precipitation_mm").cast("decimal(5,1)").alias("precipitation_mm"),
        F.col("wind_speed_kmh").cast("decimal(5,1)").alias("wind_speed_kmh"), F.col("visibility_m").cast("int").alias("visibility_m"),
    ).where("observed_ts is not null").withColumn("event_date", F.to_date("observed_ts"))
    return keep_first(typed, ("station_code", "observed_ts"), [F.asc_nulls_last(c) for c in ("condition_code", "temperature_c", "precipitation_mm", "wind_speed_kmh", "visibility_m")])


def build_rejects(df: DataFrame, batch_id: int, payload: Sequence[str], *more: str) -> DataFrame:
    """The reject table's rows: when, why, which batch, and the row itself as text, with any further columns of its own."""
    return df.where("reject_reason is not null").select(
        F.lit(batch_id).alias("batch_id"), "event_id", "event_ts", "reject_reason", *more,
        F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload]).alias("payload"),
    )


def reject_metrics(bad: DataFrame, by: str = "ingest_date") -> DataFrame:
    return bad.groupBy(by, "reject_reason").agg(F.count("*").alias("rejected_rows"))


def reconcile(events: DataFrame, by: str = "ingest_date") -> DataFrame:
    """In one pass over labelled events: what came in is what was kept and what was quarantined, for each date."""
    good, bad = F.count_if(F.col("reject_reason").isNull()), F.count_if(F.col("reject_reason").isNotNull())
    sums = events.groupBy(by).agg(F.count("*").alias("rows_in"), good.alias("rows_good"), bad.alias("rows_quarantined"))
    return sums.withColumn("balanced", F.col("rows_in") == F.col("rows_good") + F.col("rows_quarantined"))


def ingest_stats(df: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    elsewhere = F.col("event_date").isNull() | (F.col("event_date") != F.col("ingest_date"))
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(corrupt).isNotNull()).alias("corrupt"), F.count_if(F.coalesce(elsewhere, F.lit(False))).alias("other_date"))
