"""Facts: transactions, the dense periodic snapshot and the accumulating snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import cleanse, joins

#: Milestones of an incident, in order.
MILESTONES = ("detected", "dispatched", "arrived", "cleared", "closed")
#: What later states of an incident may change; the rest stays as first seen.
REFRESHED = ("dispatched_ts", "arrived_ts", "cleared_ts", "closed_ts", "unit_key", "current_status", "severity", "lanes_blocked")


def transactions(staged: DataFrame, load_date: str, keys: Sequence[str] = ("event_id",)) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of one day: duplicates are labelled first, so an invalid first row still counts as the one."""
    checked = cleanse.apply_rules(staged.where(F.col("ingest_date") == F.lit(load_date).cast("date")), C.boundary_rules())
    good, bad = cleanse.split_rejects(cleanse.label_duplicates(checked, keys, cleanse.event_order()))
    return good, bad


def weather_key(df: DataFrame, weather: DataFrame, bands: bool = True) -> DataFrame:
    """df with the weather member of its condition and, from its measures, bands; without bands that of the condition alone. Unknown is -1."""
    if bands:
        found = {"_t": C.band_temperature(F.col("avg_temp_c")), "_p": C.band_precipitation(F.col("precipitation_mm")), "_v": C.band_visibility(F.col("visibility_m"))}
    else:
        found = {c: F.lit("Unknown") for c in ("_t", "_p", "_v")}
    told = df.withColumns(found | {"_c": F.coalesce("condition_code", F.lit(C.UNKNOWN_CODE))})
    return joins.lookup_key(told, weather, {"_c": "condition_code", "_t": "temp_band", "_p": "precip_band", "_v": "visibility_band"}, "weather_key").drop("_c", "_t", "_p", "_v")


def load_fact_event(good: DataFrame, segments: DataFrame, sensors: DataFrame, vehicles: DataFrame, weather: DataFrame, cameras: DataFrame) -> DataFrame:
    """Valid events with five surrogate keys: segment and sensor as of the event's date, the rest by code; unknown is -1."""
    seg = segments.select("segment_key", "segment_code", "speed_limit", "effective_date", "expiration_date")
    out = joins.pit_join(good, seg, {"segment_code": "segment_code"}, "event_date").drop("effective_date", "expiration_date")
    sen = sensors.select("sensor_key", F.col("serial_number").alias("sensor_serial"), "effective_date", "expiration_date")
    out = joins.pit_join(out, sen, {"sensor_serial": "sensor_serial"}, "event_date")
    out = joins.lookup_key(out, vehicles, {"vehicle_type_code": "type_code"}, "vehicle_type_key")
    out = weather_key(joins.lookup_key(out, cameras, {"camera_code": "camera_code"}, "camera_key"), weather)
    known = lambda c: F.coalesce(c, F.lit(C.UNKNOWN_KEY)).alias(c)
    return out.select(
        C.date_key(F.col("event_ts")).alias("date_key"), C.time_key(F.col("event_ts")).alias("time_key"), known("segment_key"), known("sensor_key"), "camera_key", "vehicle_type_key", "weather_key",
        "detector_type", "event_id", "speed_kmh", C.over_limit(F.col("speed_kmh"), F.col("speed_limit")).alias("speed_over_limit_kmh"), "headway_seconds", "occupancy_pct",
    )


#: What the hourly fact takes from a day's aggregates; what they don't have is null.
HOURLY = {
    "hour_of_day": "int", "segment_code": "string", "vehicle_count": "long", "heavy_vehicle_count": "long", "avg_speed": "decimal(7,1)", "p85_speed": "decimal(7,1)", "avg_occupancy": "decimal(7,2)",
    "condition_code": "string", "avg_temp_c": "double", "precipitation_mm": "double", "visibility_m": "int",
}


def hourly_snapshot(measured: DataFrame, segments: DataFrame, weather: DataFrame, incidents: DataFrame, date_key: int, as_of: str | None = None) -> DataFrame:
    """Every current segment in all 24 hours of a day, each with its weather member; a day without any measured row has no snapshot.

    The spine takes current versions, or those valid on `as_of`. Hours without a row have counts of 0 and the unknown
    weather. Incidents (date_key, segment_key, hour_of_day) are counted by segment and hour.
    """
    day = measured.where(F.col("date_key") == date_key)
    valid = F.col("is_current") if as_of is None else F.lit(as_of).cast("date").between(F.col("effective_date"), F.col("expiration_date"))
    fed = day.select("date_key").distinct()
    spine = segments.where(valid & (F.col("segment_key") != C.UNKNOWN_KEY)).select("segment_key", "segment_code", "speed_limit").crossJoin(F.broadcast(fed))  # one day at most
    rows = day.select(*[(F.col(c) if c in day.columns else F.lit(None)).cast(t).alias(c) for c, t in HOURLY.items()])
    out = joins.dense_spine(spine, range(24), "hour_of_day", rows, ("segment_code", "hour_of_day"), ("vehicle_count", "heavy_vehicle_count"))
    out = weather_key(out, weather).withColumn("congestion_index", C.congestion_index(F.col("avg_speed"), F.col("speed_limit"))).drop("visibility_m", "condition_code")
    return joins.stamp_counts(out, incidents.where(F.col("date_key") == date_key).select("segment_key", "hour_of_day"), ("segment_key", "hour_of_day"), "incident_count")


def incident_keys(staged: DataFrame, kinds: DataFrame, segments: DataFrame, units: DataFrame, weather: DataFrame) -> DataFrame:
    """Staged incidents with their surrogate keys: the segment as of the day of detection, the rest by code; unknown is -1."""
    seg = segments.select("segment_key", "segment_code", "effective_date", "expiration_date")
    out = joins.pit_join(staged.withColumn("_day", F.to_date("detected_ts")), seg, {"segment_code": "segment_code"}, "_day").drop("_day", "effective_date", "expiration_date")
    out = joins.lookup_key(joins.lookup_key(out, kinds, {"incident_type_code": "type_code"}, "incident_type_key"), units, {"unit_code": "unit_code"}, "unit_key")
    known = out.withColumn("segment_key", F.coalesce("segment_key", F.lit(C.UNKNOWN_KEY)))
    return weather_key(known, weather, bands=False).drop("incident_type_code", "segment_code", "unit_code", "condition_code")


def lifecycle(source: DataFrame) -> DataFrame:
    """Date and time keys of each milestone, -1 where it isn't reached, and the lags between them in minutes."""
    out = source
    for m in MILESTONES:
        out = out.withColumns({f"{m}_date_key": C.date_key(F.col(f"{m}_ts")), f"{m}_time_key": C.time_key(F.col(f"{m}_ts"))})
    lag = lambda a, b: C.minute_lag(F.col(f"{a}_ts"), F.col(f"{b}_ts"))
    return out.withColumns({
        "minutes_to_dispatch": lag("detected", "dispatched"), "minutes_to_arrive": lag("dispatched", "arrived"),
        "minutes_to_clear": lag("arrived", "cleared"), "total_duration_minutes": lag("detected", "closed"),
    })


def upsert_lifecycle(fact: DataFrame, source: DataFrame, number: str = "incident_number", refreshed: Sequence[str] = REFRESHED) -> DataFrame:
    """The next accumulating snapshot, before its keys: known incidents take what may change from the source, new ones come in whole."""
    s = source.select(F.col(number).alias("_number"), F.struct(*source.columns).alias("_new"))
    both = fact.join(s, fact[number] == s["_number"], "full")
    new = F.col("_new")

    def column(c: str) -> Column:
        given = new.getField(c)
        if c == number:
            return F.coalesce(c, "_number").alias(c)
        take = F.col("_number").isNotNull() if c in refreshed else F.col(number).isNull()
        return F.when(take, given).otherwise(F.col(c)).alias(c)

    return both.select(*[column(c) for c in fact.columns])
