"""The eight extracts from the source system: rows changed since the last watermark, denormalised as staging wants them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.operators import joins
from lakemart.sources import feeds

Tables = dict[str, DataFrame]


def road_segments(rows: DataFrame, t: Tables) -> DataFrame:
    """Segments with their road, city, both intersections, and the start's location and district."""
    named = joins.denormalized(
        rows, (t["road"], "road_id", "road_id", {"road_code": "road_code", "road_name": "road_name", "road_category": "road_category", "city_id": "city_id"}), (t["city"], "city_id", "city_id", {"city_name": "city"}),
        (t["intersection"], "start_intersection_id", "intersection_id", {"intersection_name": "start_intersection", "location_id": "location_id"}), (t["intersection"], "end_intersection_id", "intersection_id", {"intersection_name": "end_intersection"}),
        (t["location"], "location_id", "location_id", {"latitude": "latitude", "longitude": "longitude", "district_id": "district_id"}), (t["district"], "district_id", "district_id", {"district_name": "district"}),
    )
    return named.select(
        "segment_code", "road_code", "road_name", "road_category", "city", "district", "direction", "start_intersection", "end_intersection", "latitude", "longitude", "length_m", "lane_count",
        F.col("speed_limit_kmh").alias("speed_limit"), "modified_at",
    )


def sensors(rows: DataFrame, t: Tables) -> DataFrame:
    named = joins.denormalized(rows, (t["sensor_type"], "sensor_type_id", "sensor_type_id", {"type_name": "sensor_type_name", "technology": "technology"}), (t["road_segment"], "segment_id", "segment_id", {"segment_code": "segment_code"}))
    return named.select("serial_number", "sensor_type_name", "technology", "segment_code", F.col("status").alias("status_class"), "install_date", "firmware_version", "modified_at")


def vehicle_types(rows: DataFrame, t: Tables) -> DataFrame:
    return rows.select("type_code", "type_name", "category", "is_heavy", "modified_at")


def cameras(rows: DataFrame, t: Tables) -> DataFrame:
    named = joins.denormalized(rows, (t["intersection"], "intersection_id", "intersection_id", {"intersection_name": "intersection_name"}))
    return named.select("camera_code", "intersection_name", "model", "resolution", "firmware_version", "status", "modified_at")


def lights(rows: DataFrame, t: Tables) -> DataFrame:
    named = joins.denormalized(rows, (t["intersection"], "intersection_id", "intersection_id", {"intersection_name": "intersection_name"}))
    return named.select("controller_code", "intersection_name", F.col("timing_plan").alias("current_timing_plan"), "cycle_seconds", "status", "modified_at")


def incident_types(rows: DataFrame, t: Tables) -> DataFrame:
    return rows.select("type_code", "type_name", "category", "default_severity", "modified_at")


def emergency_units(rows: DataFrame, t: Tables) -> DataFrame:
    named = joins.denormalized(rows, (t["vehicle"], "vehicle_id", "vehicle_id", {"make": "vehicle_make", "model": "vehicle_model"}))
    return named.select("unit_code", "unit_type", "home_station", "vehicle_make", "vehicle_model", "modified_at")


def incidents(rows: DataFrame, t: Tables) -> DataFrame:
    """Incidents with their type and segment, the earliest response and its unit, and the weather last observed by the time of detection."""
    named = joins.denormalized(rows, (t["incident_type"], "incident_type_id", "incident_type_id", {"type_code": "incident_type_code"}), (t["road_segment"], "segment_id", "segment_id", {"segment_code": "segment_code"}))
    first = joins.first_per_parent(named, t["police_response"], "incident_id", ("dispatched_ts", "emergency_vehicle_id"), ("dispatched_ts", "arrived_ts", "emergency_vehicle_id"))
    manned = first.join(t["emergency_vehicle"].select("emergency_vehicle_id", "unit_code"), "emergency_vehicle_id", "left")
    seen = joins.asof_join_unkeyed(manned, t["weather_observation"], "detected_ts", "observed_ts", ("condition_code",), ("station_id",))
    return seen.select(
        "incident_number", "incident_type_code", "segment_code", "unit_code", F.col("right_condition_code").alias("condition_code"), "detected_ts", "dispatched_ts", "arrived_ts", "cleared_ts", "closed_ts",
        F.col("status").alias("current_status"), "severity", "lanes_blocked", "modified_at",
    )


#: Extract -> (the source table whose changes it follows, how its rows are denormalised), in the order of loading.
EXTRACTS: dict[str, tuple[str, Callable[[DataFrame, Tables], DataFrame]]] = {
    "segment": ("road_segment", road_segments), "sensor": ("sensor", sensors), "vehicle_type": ("vehicle_type", vehicle_types), "camera": ("camera", cameras), "light": ("light", lights),
    "incident_type": ("incident_type", incident_types), "unit": ("emergency_vehicle", emergency_units), "incident": ("incident", incidents),
}


def changed(tables: Tables, marks: dict[str, object], upper: Column, full_load: bool = False, only: Sequence[str] = tuple(EXTRACTS)) -> dict[str, DataFrame]:
    """What each extract, or `only` some, have to stage: rows changed after its own table's watermark, up to one bound that is the same for all."""
    out = {}
    for name, (source, denormalise) in EXTRACTS.items():
        if name not in only:
            continue
        last = F.lit(marks[source]).cast("timestamp") if source in marks else None
        out[name] = denormalise(feeds.incremental_extract(tables[source], "modified_at", last, upper, full_load), tables)
    return out
