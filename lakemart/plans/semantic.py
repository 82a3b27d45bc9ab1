"""Views for BI tools: projections of dimensions and facts, and daily aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import analytics as A
from lakemart.plans import audit
from lakemart.plans.marts import mean

#: Plain projections: view -> the columns it shows.
PROJECTIONS = {
    "road_segment": ("segment_key", "segment_code", "road_code", "road_name", "road_category", "city", "district", "direction", "start_intersection", "end_intersection", "latitude", "longitude", "length_m", "lane_count", "speed_limit", "current_speed_limit", "is_current", "version_number", "is_inferred"),
    "sensor": ("sensor_key", "serial_number", "sensor_type_name", "technology", "segment_code", "status_class", "install_date", "is_current", "version_number", "is_inferred"),
    "weather": ("weather_key", "condition_code", "condition_name", "temp_band", "precip_band", "visibility_band", "is_severe"),
    "vehicle_type": ("vehicle_type_key", "type_code", "type_name", "category", "is_heavy"),
    "incident_type": ("incident_type_key", "type_code", "type_name", "category", "default_severity"),
    "emergency_unit": ("unit_key", "unit_code", "unit_type", "home_station", "vehicle_make", "vehicle_model"),
    "traffic_light": ("light_key", "controller_code", "intersection_name", "current_timing_plan", "previous_timing_plan", "timing_plan_changed", "cycle_seconds", "status"),
    "traffic_camera": ("camera_key", "camera_code", "intersection_name", "model", "resolution", "firmware_version", "status"),
    "hourly": ("date_key", "hour_of_day", "segment_key", "weather_key", "vehicle_count", "heavy_vehicle_count", "incident_count", "avg_speed", "p85_speed", "avg_occupancy", "congestion_index", "avg_temp_c", "precipitation_mm"),
}


def bi_view(name: str, df: DataFrame) -> DataFrame:
    """The columns that the view shows; one that df lacks is an error."""
    return df.select(*PROJECTIONS[name])


def bi_date(date: DataFrame) -> DataFrame:
    return date.where(F.col("date_key") != C.UNKNOWN_KEY).withColumn("quarter", F.concat(F.lit("Q"), F.col("quarter").cast("string")))


def bi_hour(time: DataFrame) -> DataFrame:
    return time.where("minute = 0 and time_key >= 0").select(F.col("hour").alias("hour_of_day"), F.col("time_bk").alias("hour_label"), "hour_band", "day_part", "is_rush_hour")


def bi_time_of_day(time: DataFrame) -> DataFrame:
    return time.select("time_key", F.col("time_bk").alias("time"), "hour", "minute", "hour_band", "day_part", "is_rush_hour")


def bi_incidents(fil: DataFrame) -> DataFrame:
    return fil.withColumns({
        "met_response_sla": C.within(F.col("minutes_to_arrive"), C.RESPONSE_MINUTES), "met_clearance_sla": C.within(F.col("minutes_to_clear"), C.CLEARANCE_MINUTES),
        "is_closed": (F.col("closed_date_key") != C.UNKNOWN_KEY).cast("int"),
    })


def bi_traffic_daily(fte: DataFrame) -> DataFrame:
    return fte.groupBy("date_key", "segment_key", "vehicle_type_key", "weather_key").agg(
        F.count("*").alias("detections"), mean("speed_kmh").alias("avg_speed"), F.max("speed_kmh").alias("max_speed"), F.count_if(F.col("speed_over_limit_kmh") > 0).alias("speeding_detections"), mean("occupancy_pct").alias("avg_occupancy"), mean("headway_seconds").alias("avg_headway_seconds")
    )


def bi_detector_daily(fte: DataFrame, technology: str, key: str) -> DataFrame:
    """Detections, hours with any and their share of the day, by detector of one technology."""
    hours = A.hours_in(A.hours_seen(F.floor(F.col("time_key") / 60)))
    made = fte.where(F.col("detector_type") == technology).groupBy("date_key", key).agg(
        F.count("*").alias("detections"), hours.alias("active_hours"), mean("speed_kmh").alias("avg_speed"), F.count_if(F.col("speed_over_limit_kmh") > 0).alias("speeding_detections")
    )
    return made.withColumn("uptime_pct", F.col("active_hours").cast("double") * 100 / 24)


def bi_kpi_daily(fht: DataFrame, fil: DataFrame, fte: DataFrame, sensors: DataFrame) -> DataFrame:
    """The day's scorecard: traffic, incidents, response percentiles and the share of sensors that reported."""
    traffic = A.weighted_avg(
        fht, ("date_key",), {"avg_speed": "network_avg_speed", "congestion_index": "network_congestion"}, "vehicle_count", "total_vehicles",
        F.sum("heavy_vehicle_count").alias("heavy_vehicles"), A.distinct_where(F.col("segment_key"), F.col("vehicle_count") > 0).alias("segments_with_traffic"),
    )
    day = F.col("detected_date_key").alias("date_key")
    met = A.share(F.col("minutes_to_arrive") <= C.RESPONSE_MINUTES, F.col("minutes_to_arrive"))
    incidents = fil.groupBy(day).agg(F.count("*").alias("incidents"), met.alias("response_sla_pct"), mean("minutes_to_clear").cast("int").alias("avg_clearance_min"))
    response = A.percentiles(fil.withColumnRenamed("detected_date_key", "date_key"), ("date_key",), "minutes_to_arrive", {"median_response_min": 0.5, "p90_response_min": 0.9})
    reporting = fte.where(F.col("sensor_key") != C.UNKNOWN_KEY).groupBy("date_key").agg(F.count_distinct("sensor_key").alias("reporting_sensors"))
    whole = sensors.where(F.col("is_current") & (F.col("sensor_key") != C.UNKNOWN_KEY)).agg(F.count("*").alias("_sensors"))
    out = traffic.join(incidents, "date_key", "left").join(response, "date_key", "left").join(reporting, "date_key", "left").crossJoin(F.broadcast(whole))  # one row
    health = F.coalesce("reporting_sensors", F.lit(0)).cast("double") * 100 / F.nullif("_sensors", F.lit(0)).cast("double")
    return out.withColumns({"incidents": F.coalesce("incidents", F.lit(0)), "sensor_health_pct": health}).drop("_sensors")


def bi_reject_daily(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy(C.date_key(F.col("event_ts")).alias("date_key"), "reject_reason", "sensor_serial").agg(F.count("*").alias("rejected_rows"))


def bi_etl_batches(batches: DataFrame, rows: DataFrame) -> DataFrame:
    return audit.batch_detail(batches, rows).withColumn("date_key", C.date_key(F.col("load_date")))


def bi_quality_checks(log: DataFrame, batches: DataFrame) -> DataFrame:
    return log.join(batches.select("batch_id", C.date_key(F.col("load_date")).alias("date_key")), "batch_id", "left")


def fact_grains(**facts: DataFrame) -> DataFrame:
    from lakemart.operators.cleanse import labelled_union

    return labelled_union({k: x.agg(F.count("*").alias("rows")) for k, x in facts.items()}, "fact")


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reject_reason").agg(F.count("*").alias("rejected_rows"))


def detector_mix(fte: DataFrame) -> DataFrame:
    return fte.groupBy("detector_type").agg(F.count("*").alias("detections"))


def rules_fired(rejects: DataFrame, reasons: DataFrame) -> DataFrame:
    """Every known rule with the rows it rejected; one that never fired is armed."""
    counts = rejects_by_reason(rejects)
    return reasons.join(counts, "reject_reason", "left").fillna(0, ["rejected_rows"]).withColumn("status", F.when(F.col("rejected_rows") > 0, "FIRED").otherwise("ARMED"))


def gold_summary(hourly: DataFrame) -> DataFrame:
    """The lake's hourly aggregates in one row: what stands in when there is no warehouse."""
    return hourly.agg(F.count("*").alias("segment_hours"), F.sum("vehicle_count").alias("total_vehicles"), mean("avg_speed").alias("avg_speed"), F.count_distinct("segment_code").alias("segments"))


def year_over_year(df: DataFrame, year: str, measure: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each year's sum beside that of the year before, and the change in percent."""
    sums = df.groupBy(year, *by).agg(F.sum(measure).alias("total"))
    before = sums.select((F.col(year) + 1).alias(year), *by, F.col("total").alias("previous"))
    return sums.join(before, [year, *by], "left").withColumn("yoy_pct", (F.col("total") - F.col("previous")).cast("double") * 100 / F.nullif("previous", F.lit(0)).cast("double"))


def bi_measure(name: str, fht: DataFrame, fil: DataFrame, fte: DataFrame, rejects: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One of the report's measures, by columns of its table."""
    known = {
        "heavy_share": (fht, F.sum("heavy_vehicle_count").cast("double") * 100 / F.nullif(F.sum("vehicle_count"), F.lit(0)).cast("double")),
        "speeding_share": (fte, A.share(F.col("speed_over_limit_kmh") > 0)),
        "response_p90": (fil, F.percentile("minutes_to_arrive", F.lit(0.9))),
        "clearance_p50": (fil, F.percentile("minutes_to_clear", F.lit(0.5))),
        "response_sla": (fil, A.share(F.col("minutes_to_arrive") <= C.RESPONSE_MINUTES, F.col("minutes_to_arrive"))),
        "closed_count": (fil, F.count_if(F.col("closed_date_key") != C.UNKNOWN_KEY)),
        "uptime": (fte, A.distinct_where(F.concat_ws(":", "date_key", F.floor(F.col("time_key") / 60)), F.col("time_key") >= 0).cast("double") * 100 / (24 * F.count_distinct("date_key")).cast("double")),
    }
    if name == "reject_rate":
        bad, all_ = rejects.groupBy(*by).agg(F.count("*").alias("b")), fte.groupBy(*by).agg(F.count("*").alias("g"))
        both = bad.join(all_, [*by], "full") if by else bad.crossJoin(all_)  # without columns two single rows
        counted = both.fillna(0, ["b", "g"])
        return counted.select(*by, (F.col("b").cast("double") * 100 / F.nullif(F.col("b") + F.col("g"), F.lit(0)).cast("double")).alias(name))
    df, value = known[name]
    return df.groupBy(*by).agg(value.alias(name))
