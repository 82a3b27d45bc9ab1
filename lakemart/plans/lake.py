"""The lake's jobs, a day at a time: bronze, silver, gold, KPIs and the warehouse's load. Each can be run again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import analytics as A
from lakemart.operators import cleanse, joins
from lakemart.plans import audit, kpis
from lakemart.sources import feeds, sinks
from lakemart.sources.scratch import cleared, written

HEAVY = ("TRK", "ART", "BUS")


#: Feed -> (its reader, its files' kind).
FEEDS = {"sensor_readings": (feeds.read_csv_feed, "csv"), "camera_events": (feeds.read_camera_json, "json"), "weather_observations": (feeds.read_weather_json, "json")}


def ingest(spark: SparkSession, raw: str, lake: str, load_date: str | None, batch_id: int, only: Sequence[str] = tuple(FEEDS)) -> None:
    """Files of a date (or all) to bronze, as they came, by the date in their names."""
    for feed in only:
        read, kind = FEEDS[feed]
        rows = read(spark, feeds.pattern(raw, feed, kind, load_date), batch_id=batch_id)
        sinks.write_partitioned(rows, f"{lake}/bronze/{feed}", "ingest_date")


def conformed_bronze(spark: SparkSession, lake: str, load_date: str) -> DataFrame:
    """The readable events of both feeds of a date in one shape, normalised."""
    zone = lambda name: cleanse.split_corrupt(feeds.read_zone(spark, f"{lake}/bronze/{name}", "ingest_date", load_date))[0]
    return cleanse.normalize(cleanse.union_feeds(cleanse.conform_sensor(zone("sensor_readings")), cleanse.conform_camera(zone("camera_events"))))


def clean(spark: SparkSession, lake: str, load_date: str, now: Column | None = None) -> None:
    """Bronze of a date to silver: every row is kept or quarantined with a reason, and the counts are written as data.

    Corrupt rows keep what could be parsed of them, and the raw line.
    """
    clean_events(spark, lake, load_date, now)
    clean_observations(spark, lake, load_date)


def clean_events(spark: SparkSession, lake: str, load_date: str, now: Column | None = None) -> None:
    zone = lambda name: feeds.read_zone(spark, f"{lake}/bronze/{name}", "ingest_date", load_date)
    (_, bad_lines), (_, bad_records) = cleanse.split_corrupt(zone("sensor_readings")), cleanse.split_corrupt(zone("camera_events"))
    events = conformed_bronze(spark, lake, load_date)
    checked = cleanse.label_duplicates(cleanse.apply_rules(events, [*C.event_rules(now), C.unknown_ingest_date()]), ("event_id",), cleanse.event_order())
    raw = lambda df, conform: conform(df.withColumnRenamed("_corrupt_record", "raw_line"), "raw_line", "reject_reason")
    corrupt = cleanse.union_feeds(raw(bad_lines, cleanse.conform_sensor), raw(bad_records, cleanse.conform_camera))
    with cleared(spark):
        every = written(checked.withColumn("raw_line", F.lit(None).cast("string")).unionByName(corrupt), "checked")  # four sinks read it
        good, bad = cleanse.split_rejects(every)
        day = F.lit(load_date).cast("date")
        sinks.replace_slice(good.drop("raw_line").withColumn("event_date", day), f"{lake}/silver/events", "event_date", load_date, sort=("segment_code", "event_ts"))
        for rows, name in ((bad, "quarantine"), (cleanse.reject_metrics(bad), "quality_metrics"), (cleanse.reconcile(every), "reconciliation")):
            sinks.replace_slice(rows.withColumn("ingest_date", day), f"{lake}/silver/{name}", "ingest_date", load_date)


def clean_observations(spark: SparkSession, lake: str, load_date: str) -> None:
    """Bronze weather of a date to silver; what can't be read, or is of another date than its file, is quarantined beside the events."""
    day = F.lit(load_date).cast("date")
    observed, unread = cleanse.split_corrupt(feeds.read_zone(spark, f"{lake}/bronze/weather_observations", "ingest_date", load_date))
    sinks.replace_slice(cleanse.clean_weather(observed), f"{lake}/silver/weather", "event_date", load_date)
    reason = F.when(F.col("observed_ts").isNull(), "MISSING_KEY").when(F.to_date("observed_ts") != day, "DATE_MISMATCH")
    astray = observed.withColumns({"reject_reason": reason, "_corrupt_record": F.lit(None).cast("string")}).where("reject_reason is not null")
    sinks.replace_slice(astray.unionByName(unread).withColumn("ingest_date", day), f"{lake}/silver/weather_quarantine", "ingest_date", load_date)


def transform(spark: SparkSession, lake: str, load_date: str) -> None:
    """Silver of a date to the hourly aggregate, with the hour's weather, and to enriched events."""
    events = feeds.read_zone(spark, f"{lake}/silver/events", "event_date", load_date).withColumn("hour_of_day", F.hour("event_ts"))
    weather = A.weather_hourly(feeds.read_zone(spark, f"{lake}/silver/weather", "event_date", load_date))
    enriched = events.join(F.broadcast(weather), ["event_date", "hour_of_day"], "left")  # 24 rows a day
    attributes = [F.max(c).alias(c) for c in ("condition_code", "avg_temp_c", "precipitation_mm", "visibility_m")]  # one value an hour
    hourly = A.hourly(enriched, ("event_date", "hour_of_day", "segment_code"), F.col("vehicle_type_code").isin(*HEAVY), "speed_kmh", "occupancy_pct", *attributes)
    sinks.replace_slice(hourly, f"{lake}/gold/hourly_traffic", "event_date", load_date)
    sinks.replace_slice(enriched.drop("hour_of_day"), f"{lake}/gold/traffic_events", "event_date", load_date)


def generate_kpis(spark: SparkSession, lake: str) -> None:
    hourly = spark.read.parquet(f"{lake}/gold/hourly_traffic")
    metrics = feeds.read_known(spark, f"{lake}/silver/quality_metrics", "reject_reason string, rejected_rows long, ingest_date date")
    sinks.write_partitioned(kpis.kpi_segment_daily(hourly), f"{lake}/gold/kpi_segment_daily", "event_date")
    for name, df in (("kpi_weather_penalty", kpis.kpi_weather_penalty(hourly)), ("kpi_rush_hours", kpis.kpi_rush_hours(hourly)), ("quality_daily", kpis.quality_daily(metrics, hourly))):
        sinks.write_full(df, f"{lake}/gold/{name}")


def reconcile(spark: SparkSession, lake: str, manifest: DataFrame | None = None) -> DataFrame:
    """What bronze has is what silver kept and quarantined; gold counts no more than silver. Counts that are data are summed."""
    read = lambda name: spark.read.parquet(f"{lake}/{name}")
    bronze = read("bronze/sensor_readings").select("event_id").unionByName(read("bronze/camera_events").select("event_id"))
    silver = read("silver/events").select("event_id").unionByName(feeds.read_known(spark, f"{lake}/silver/quarantine", "event_id string").select("event_id"))
    checks = {"bronze_is_silver": (bronze, silver, "="), "gold_within_silver": (read("gold/hourly_traffic").agg(F.sum("vehicle_count").alias("n")), read("silver/events"), "<=")}
    if manifest is not None:
        checks["manifest_is_bronze"] = (manifest.agg(F.sum(F.col("sensor_csv_rows") + F.col("camera_events")).alias("n")), bronze, "=")
    return audit.reconcile_zones(checks)


def run_day(spark: SparkSession, raw: str, lake: str, load_date: str, batch_id: int, now: Column | None = None, log: audit.BatchLog | None = None, then: Callable[[], None] | None = None) -> None:
    """All jobs of a date in order. The batch is logged as started, and as ended or failed; `then`, such as the advance of watermarks, comes last."""
    began = datetime.now(timezone.utc)
    day = datetime.strptime(load_date, "%Y-%m-%d").date()
    if log:
        log.put(batch_id, "nightly", day, "Running", began)
    try:
        ingest(spark, raw, lake, load_date, batch_id)
        clean(spark, lake, load_date, now)
        transform(spark, lake, load_date)
        generate_kpis(spark, lake)
        if then:
            then()
    except Exception as e:
        if log:
            log.put(batch_id, "nightly", day, "Failed", began, str(e)[:500])
        raise
    if log:
        log.put(batch_id, "nightly", day, "Succeeded", began)


def staged_events(spark: SparkSession, lake: str, load_date: str) -> DataFrame:
    """What the warehouse takes over from the lake's enriched events: the staging contract's columns, under the warehouse's names for them."""
    rows = feeds.read_zone(spark, f"{lake}/gold/traffic_events", "event_date", load_date)
    return sinks.to_staging(rows.withColumn("ingest_date", F.coalesce("ingest_date", "event_date")), sinks.STAGED_EVENT)


def staged_hourly(spark: SparkSession, lake: str, load_date: str) -> DataFrame:
    """A day's hourly aggregates for the warehouse."""
    return sinks.to_staging(feeds.read_zone(spark, f"{lake}/gold/hourly_traffic", "event_date", load_date).withColumn("date_key", C.date_key(F.col("event_date"))), sinks.STAGED_HOURLY)


def first_incident_responders(incidents: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Each incident with its earliest dispatch."""
    return joins.first_per_parent(incidents, dispatches, "incident_id", ("dispatched_ts", "unit_code"), ("unit_code", "dispatched_ts"))
