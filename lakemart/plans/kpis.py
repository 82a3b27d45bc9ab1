"""KPI datasets over the hourly aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemart.operators import analytics as A
from lakemart.operators import joins

#: Every reason a row can be rejected for.
REASONS = ("CORRUPT_RECORD", "MISSING_KEY", "SPEED_RANGE", "OCCUPANCY_RANGE", "FUTURE_TIMESTAMP", "DATE_MISMATCH", "BAD_DIRECTION", "DUPLICATE")


def kpi_segment_daily(hourly: DataFrame) -> DataFrame:
    """Volume, mean speed, peak hour, rank on the day and change from the day before, by segment and day."""
    daily = hourly.groupBy("event_date", "segment_code").agg(
        F.sum("vehicle_count").alias("day_volume"), (F.sum("avg_speed").cast("double") / F.count("avg_speed")).alias("avg_speed"),
        A.peak("vehicle_count", "hour_of_day").alias("peak_hour"), F.max("vehicle_count").alias("peak_hour_volume"),
    )
    before = F.lag("day_volume").over(Window.partitionBy("segment_code").orderBy("event_date"))
    return daily.withColumns({
        "volume_rank": F.rank().over(Window.partitionBy("event_date").orderBy(F.desc("day_volume"))), "volume_delta": F.col("day_volume") - before,
    })


def kpi_weather_penalty(hourly: DataFrame, baseline: str = "DRY") -> DataFrame:
    """How much slower, in percent, each condition is than the baseline, by segment."""
    known = hourly.where("condition_code is not null and avg_speed is not null")
    speed = known.groupBy("segment_code", "condition_code").agg((F.sum("avg_speed").cast("double") / F.count("*")).alias("avg_speed"))
    both = A.partition_baseline(speed, ("segment_code",), F.col("condition_code") == baseline, "avg_speed", "dry_baseline")
    penalty = (F.col("dry_baseline") - F.col("avg_speed")) * 100 / F.col("dry_baseline")
    return both.where((F.col("condition_code") != baseline) & F.col("dry_baseline").isNotNull()).withColumn("speed_penalty_pct", penalty)


def kpi_rush_hours(hourly: DataFrame, n: int = 3) -> DataFrame:
    """The hours of the greatest 85th percentile of volume, by segment and weekday (1 is Sunday)."""
    volumes = hourly.groupBy("segment_code", F.dayofweek("event_date").alias("weekday"), F.col("hour_of_day").alias("predicted_peak_hour")).agg(F.percentile_approx("vehicle_count", F.lit(0.85), F.lit(10000)).alias("p85_volume"))
    return A.top_n_per_group(volumes, ("segment_code", "weekday"), [F.desc("p85_volume"), F.col("predicted_peak_hour")], n, "_rank").drop("_rank")


def quality_daily(metrics: DataFrame, hourly: DataFrame, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """Rejected rows by reason beside valid detections, per load date."""
    by_reason = A.pivoted(metrics.withColumnRenamed("ingest_date", "load_date"), "load_date", "reject_reason", reasons, "rejected_rows")
    valid = hourly.groupBy(F.col("event_date").alias("load_date")).agg(F.sum("vehicle_count").alias("valid_detections"))
    return joins.full_counts(by_reason, valid, "load_date")
