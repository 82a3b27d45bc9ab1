"""Report marts over the star: fht is the hourly snapshot, fte the events, fil the incidents.

Averages that are rolled up are weighted by volume, without rounding: a caller casts them for display.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import analytics as A
from lakemart.operators import joins

SPEED, CONGESTION = {"avg_speed": "avg_speed"}, {"congestion_index": "avg_congestion"}


def _volume(df: DataFrame, by: Sequence[str], measures: dict[str, str], *more: Column, total: str = "total_vehicles") -> DataFrame:
    return A.weighted_avg(df, by, measures, "vehicle_count", total, *more)


def mean(column: str) -> Column:
    return F.sum(column).cast("double") / F.nullif(F.count(column), F.lit(0)).cast("double")


def mart_dim_road(seg: DataFrame) -> DataFrame:
    return seg.where(F.col("is_current") & (F.col("segment_key") != C.UNKNOWN_KEY)).select("road_code", "road_name", "road_category", "city").distinct()


def mart_dim_location(seg: DataFrame) -> DataFrame:
    return seg.where(F.col("is_current") & (F.col("segment_key") != C.UNKNOWN_KEY)).select("city", "district").distinct()


def mart_top_busiest_roads(fht: DataFrame, seg: DataFrame, n: int = 10) -> DataFrame:
    return A.top_with_ties(_volume(fht.join(seg, "segment_key"), ("road_name", "road_category"), SPEED | CONGESTION), "total_vehicles", n)


def mart_avg_speed_by_road(fht: DataFrame, seg: DataFrame) -> DataFrame:
    known = fht.where("avg_speed is not null").join(seg, "segment_key")
    return _volume(known, ("road_name",), {"avg_speed": "weighted_speed", "p85_speed": "weighted_p85"}, F.max("speed_limit").alias("max_speed_limit")).drop("total_vehicles")


def mart_monthly(fht: DataFrame, date: DataFrame) -> DataFrame:
    more = (F.sum("heavy_vehicle_count").alias("heavy_vehicles"), F.sum("incident_count").alias("incidents"))
    return _volume(fht.join(date, "date_key"), ("year", "month_number", "year_month"), CONGESTION, *more)


def mart_daily(fht: DataFrame, date: DataFrame) -> DataFrame:
    return _volume(fht.join(date, "date_key"), ("full_date", "day_name", "is_weekend", "is_holiday"), SPEED | CONGESTION)


def mart_rush_hour(fht: DataFrame, date: DataFrame) -> DataFrame:
    return _volume(fht.join(date, "date_key"), ("hour_of_day", "is_weekend"), SPEED | CONGESTION)


def mart_accident_hotspots(fil: DataFrame, seg: DataFrame, kinds: DataFrame, category: str = "Accident") -> DataFrame:
    rows = joins.star_join(fil, {"segment_key": seg, "incident_type_key": kinds.where(F.col("category") == category)})
    return rows.groupBy("road_name", "segment_code", "district").agg(
        F.count("*").alias("accidents"), mean("severity").alias("avg_severity"), F.sum("lanes_blocked").alias("total_lanes_blocked"), mean("minutes_to_clear").alias("avg_clearance_min")
    )


def mart_vehicle_stats(fte: DataFrame, vehicles: DataFrame, over: int = 10) -> DataFrame:
    return fte.join(vehicles, "vehicle_type_key").groupBy("category", "type_name").agg(
        F.count("*").alias("detections"), mean("speed_kmh").alias("avg_speed"), mean("speed_over_limit_kmh").alias("avg_over_limit"), F.count_if(F.col("speed_over_limit_kmh") > over).alias("speeding_detections")
    )


def mart_by_weather(fht: DataFrame, weather: DataFrame) -> DataFrame:
    """Of hours with traffic: empty ones have no weather to speak of."""
    return _volume(fht.where("vehicle_count > 0").join(weather, "weather_key"), ("condition_name", "precip_band", "is_severe"), SPEED | CONGESTION)


def mart_by_district(fht: DataFrame, seg: DataFrame) -> DataFrame:
    return _volume(fht.join(seg, "segment_key"), ("city", "district"), CONGESTION, F.sum("incident_count").alias("incidents"))


def mart_by_weekday(fht: DataFrame, date: DataFrame) -> DataFrame:
    return _volume(fht.join(date, "date_key"), ("day_of_week", "day_name"), SPEED | CONGESTION)


def mart_light_performance(fht: DataFrame, seg: DataFrame, lights: DataFrame) -> DataFrame:
    """Volume at each controller's intersection, and vehicles per cycle: volume over the cycles of its hours."""
    rows = fht.join(seg, "segment_key").join(lights.withColumnRenamed("intersection_name", "end_intersection"), "end_intersection")
    by = ("controller_code", "end_intersection", "current_timing_plan", "previous_timing_plan", "timing_plan_changed", "cycle_seconds")
    made = _volume(rows, by, {"congestion_index": "avg_approach_congestion"}, F.count("*").alias("_hours"), total="approach_volume")
    return made.withColumn("vehicles_per_cycle", F.col("approach_volume") * F.col("cycle_seconds") / (F.col("_hours") * 3600)).drop("_hours")


def mart_emergency_response(fil: DataFrame, date: DataFrame, kinds: DataFrame, units: DataFrame) -> DataFrame:
    rows = joins.star_join(joins.role_join(fil, date, "detected_date_key", "date_key", "", ("year_month",)), {"incident_type_key": kinds, "unit_key": units})
    reached = {"minutes_to_dispatch": "avg_dispatch_min", "minutes_to_arrive": "avg_response_min", "minutes_to_clear": "avg_clearance_min", "total_duration_minutes": "avg_total_min"}
    return rows.groupBy("year_month", "category", "unit_type").agg(
        F.count("*").alias("incidents"), *[mean(c).alias(n) for c, n in reached.items()], A.share(F.col("minutes_to_arrive") <= C.RESPONSE_MINUTES, F.col("minutes_to_arrive")).alias("response_sla_pct")
    )


def mart_top_intersections(fht: DataFrame, seg: DataFrame, n: int = 10) -> DataFrame:
    """The most congested; ties count as equal after rounding to three decimals."""
    known = fht.where("congestion_index is not null").join(seg, "segment_key")
    made = _volume(known, ("end_intersection", "district"), {"congestion_index": "weighted_congestion"}, total="approach_volume")
    return A.top_with_ties(made.withColumn("weighted_congestion", F.col("weighted_congestion").cast("decimal(4,3)")), "weighted_congestion", n)


def mart_fact_daily(fht: DataFrame, date: DataFrame) -> DataFrame:
    more = (F.sum("heavy_vehicle_count").alias("heavy_vehicles"), F.sum("incident_count").alias("incidents"))
    return _volume(fht.join(date, "date_key"), ("date_key", "full_date", "day_name", "is_weekend"), SPEED | CONGESTION, *more)


def accident_rate(fil: DataFrame, fht: DataFrame, seg: DataFrame) -> DataFrame:
    """Incidents per million vehicle-kilometres, by road."""
    driven = fht.join(seg, "segment_key").groupBy("road_name").agg(F.sum(F.col("vehicle_count") * F.col("length_m")).alias("vehicle_m"))
    met = fil.join(seg, "segment_key").groupBy("road_name").agg(F.count("*").alias("incidents"))
    out = driven.join(met, "road_name", "left").fillna(0, ["incidents"])
    return out.withColumn("per_million_vehicle_km", F.col("incidents").cast("double") * 1e9 / F.nullif(F.col("vehicle_m"), F.lit(0)).cast("double"))
