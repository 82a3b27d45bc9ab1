"""The driver's tables as the feeds and the source system that the lake and the warehouse load: built in Spark, in the shared folder, once a session."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.plans import lake, warehouse
from lakemart.plans import tables as T
from lakemart.sources import sinks
from lakemart.sources.scratch import fresh_path

_made: dict[tuple[str, str, str], dict[str, object]] = {}
#: Events in one JSON file of a feed.
CHUNK = 1000
#: Lines of the sensors' feed are written as they are, under its header.
HEADER = "event_id,event_ts,sensor_serial,segment_code,direction,vehicle_type_code,speed_kmh,headway_seconds,occupancy_pct"
PLAIN = {"header": "true", "sep": "\u0001", "quote": "\u0002", "compression": "none"}


def _once(kind: str, spark: SparkSession, sf_dir: str) -> tuple[dict[str, object], bool]:
    """(what was made under this name, filled in once it is whole; whether it is still to be made)."""
    made = _made.setdefault((kind, spark.sparkContext.applicationId, sf_dir), {})
    return made, not made


def first_day(spark: SparkSession, sf_dir: str) -> date:
    return T.table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")).alias("d")).first().d


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def raw_events(spark: SparkSession, sf_dir: str, day: date, copies: int = 1) -> DataFrame:
    """All events, each `copies` times with ids of their own, moved to one day, with defects: some codes are blank or N/A, some speeds, shares, times and directions wrong."""
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(day).cast("timestamp")) + F.unix_timestamp(F.col("event_ts").cast("timestamp")) % 86400)
    moved = F.when(_every(67), F.date_add(F.lit(day), 365)).when(_every(71), F.date_sub(F.lit(day), 1))
    rows = T.detections(spark, sf_dir).withColumn("ts", ts)
    if copies > 1:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("event_id", F.col("event_id") * copies + F.col("copy"))
    at = F.when(moved.isNotNull(), F.timestamp_seconds(F.unix_timestamp(moved.cast("timestamp")) + F.unix_timestamp("ts") % 86400)).otherwise(F.col("ts"))
    return rows.select(
        F.col("event_id").alias("id"), F.col("event_id"), at.alias("event_ts"), (F.col("event_id") % 3 == 0).alias("is_camera"), F.when(_every(97), "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("detector"),
        F.when(_every(101), " n/a ").otherwise(F.concat(F.lit(" s"), (F.col("user_id") % 50).cast("string"))).alias("segment_code"), F.when(_every(53), "XX").otherwise(F.element_at(F.array(*[F.lit(x) for x in C.DIRECTIONS]), (F.col("event_id") % 4 + 1).cast("int"))).alias("direction"),
        "event_type", F.when(_every(89), F.lit(999)).otherwise(F.col("speed_kmh")).cast("decimal(5,1)").alias("speed_kmh"), F.col("headway_seconds"), F.when(_every(61), F.lit(150)).otherwise(F.col("occupancy_pct")).alias("occupancy_pct"),
    )


def _raw(spark: SparkSession, sf_dir: str, copies: int) -> dict[str, object]:
    """Where the feeds of a day are landed: {raw, day}."""
    made, fresh = _once(f"raw {copies}", spark, sf_dir)
    if fresh:
        made.update(day=str(first_day(spark, sf_dir)), raw=f"{fresh_path(spark, 'feeds')}/raw")
    return made


def land(spark: SparkSession, sf_dir: str, copies: int = 1) -> dict[str, object]:
    """The three feeds of a day as files, and a few lines of the next day: {raw, day}."""
    made, fresh = _once(f"feeds {copies}", spark, sf_dir)
    if not fresh:
        return made
    at = _raw(spark, sf_dir, copies)
    day, raw = date.fromisoformat(at["day"]), at["raw"]
    tag, next_tag = day.strftime("%Y%m%d"), (day + timedelta(days=1)).strftime("%Y%m%d")
    rows = raw_events(spark, sf_dir, day, copies)
    sensors = rows.where("not is_camera")
    told = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    line = F.concat_ws(",", "event_id", told, "detector", "segment_code", "direction", "event_type", "speed_kmh", "headway_seconds", "occupancy_pct")
    lines = F.array(line, F.when(_every(83), line), F.when(_every(79), F.concat(F.lit("bad"), F.col("event_id").cast("string"), F.lit(",what"))))  # copies, and lines that end early
    text = sensors.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias(HEADER))
    text.write.options(**PLAIN).csv(f"{raw}/sensor_readings_{tag}.csv")
    sensors.where(_every(10)).select(line.alias(HEADER)).write.options(**PLAIN).csv(f"{raw}/sensor_readings_{next_tag}.csv")
    detection = F.struct(told.alias("timestamp"), "segment_code", "direction", F.col("event_type").alias("vehicle_class"), "speed_kmh", F.lit("h").alias("plate_hash"))
    cameras = rows.where("is_camera").select(F.struct(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("detector") != "", F.concat(F.lit("k"), "detector")).alias("camera_code"), detection.alias("detection")).alias("row"), F.col("id"))
    chunks = cameras.groupBy(F.floor(F.col("id") / CHUNK)).agg(F.to_json(F.collect_list("row")).alias("text")).select("text")  # each a file of its own
    chunks.write.option("compression", "none").option("maxRecordsPerFile", 1).text(f"{raw}/camera_events_{tag}.json")
    made.update(land_weather(spark, sf_dir, copies))
    return made


def land_weather(spark: SparkSession, sf_dir: str, copies: int = 1) -> dict[str, object]:
    """The day's weather alone, an observation for each hour and station that the events have: {raw, day}."""
    made, fresh = _once(f"weather feed {copies}", spark, sf_dir)
    if not fresh:
        return made
    at = _raw(spark, sf_dir, copies)
    day, raw = date.fromisoformat(at["day"]), at["raw"]
    rows = raw_events(spark, sf_dir, day, copies)
    h, st = F.hour("event_ts"), F.col("id") % 3
    hours = rows.groupBy(h.alias("h"), st.alias("st")).agg(F.count("*").alias("n"))
    observed = F.concat(F.lit(f"{day}T"), F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":10:00"))
    one = F.struct(
        F.concat(F.lit("w"), F.col("st").cast("string")).alias("station_code"), observed.alias("observed_at"), ((F.col("h") * 3 + F.col("st") * 2) % 40 - 8).cast("double").alias("temperature_c"), ((F.col("h") + F.col("st")) % 9).cast("double").alias("precipitation_mm"),
        F.lit(5.0).alias("wind_speed_kmh"), (F.col("h") * 150 + F.col("st") * 10).cast("int").alias("visibility_m"), F.lower(F.element_at(F.array(*[F.lit(c) for c in C.CONDITIONS]), ((F.col("h") + F.col("st")) % 6 + 1).cast("int"))).alias("condition_code"),
    )
    twice = hours.select(F.explode(F.when(F.col("h") % 5 == 0, F.array(one, one)).otherwise(F.array(one))).alias("row"))  # a row an hour and station
    twice.agg(F.to_json(F.collect_list("row")).alias("text")).write.option("compression", "none").text(f"{raw}/weather_observations_{day:%Y%m%d}.json")
    made.update(at)
    return made


def run_lake(spark: SparkSession, sf_dir: str, copies: int = 1) -> dict[str, object]:
    """The lake after a day's jobs over the landed feeds: {lake, day, raw}."""
    made, fresh = _once(f"lake {copies}", spark, sf_dir)
    if fresh:
        fed = land(spark, sf_dir, copies)
        path = fresh_path(spark, "lake")
        lake.run_day(spark, fed["raw"], path, fed["day"], 1, now=(F.lit(fed["day"]).cast("date") + F.expr("interval 10 days")).cast("timestamp"))
        made.update(fed, lake=path)
    return made


def run_weather(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    """A lake with the weather's jobs of the day, which need no event; the whole lake, if the session has it: {lake, day, raw}."""
    whole, missing = _once("lake 1", spark, sf_dir)
    made, fresh = _once("weather", spark, sf_dir) if missing else (whole, False)
    if fresh:
        fed = land_weather(spark, sf_dir)
        path = fresh_path(spark, "weather-lake")
        lake.ingest(spark, fed["raw"], path, fed["day"], 1, ("weather_observations",))
        lake.clean_observations(spark, path, fed["day"])
        made.update(fed, lake=path)
    return made


# ---------------------------------------------------------------- the source system

CHANGED = "modified_at"


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that the extracts read: places from nations and regions, detectors from events, units from parts, incidents from orders."""
    t = lambda n: T.table(spark, sf_dir, n)
    n, r, k = F.col("n_nationkey"), F.col("r_regionkey"), F.col("k")
    old = F.lit("1994-06-01").cast("timestamp").alias(CHANGED)
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    users = t("events").select(F.col("user_id").alias("k"), (F.col("event_id") % 3 == 0).alias("is_camera")).distinct()
    inc = T.incident_source(spark, sf_dir).withColumn("day", F.to_date("detected_ts"))
    late = F.timestamp_seconds(F.unix_timestamp("dispatched_ts") + 30)
    unit_of = (F.col("incident_number") % 20 * 10 + 10).alias("emergency_vehicle_id")
    first = inc.where("dispatched_ts is not null").select(F.col("incident_number").alias("incident_id"), "dispatched_ts", "arrived_ts", unit_of)
    stations = inc.select("day", (F.col("incident_number") % 3).alias("st")).distinct()
    kinds = F.element_at(F.array(*[F.lit(c) for c in C.CONDITIONS]), ((F.dayofyear("day") + F.col("st")) % 6 + 1).cast("int"))
    return {
        "city": t("region").select(r.alias("city_id"), F.col("r_name").alias("city_name")), "district": t("region").select(r.alias("district_id"), text("D ", F.col("r_name")).alias("district_name")),
        "road": t("nation").select(n.alias("road_id"), text("R", n).alias("road_code"), F.col("n_name").alias("road_name"), text("C", n % 3).alias("road_category"), F.col("n_regionkey").alias("city_id")),
        "location": t("nation").select(n.alias("location_id"), (n + 40).cast("decimal(9,6)").alias("latitude"), (n + 20).cast("decimal(9,6)").alias("longitude"), (n % 5).alias("district_id")),
        "intersection": t("nation").select(n.alias("intersection_id"), text("X", n).alias("intersection_name"), n.alias("location_id")),
        "road_segment": T.segments(spark, sf_dir).select(
            F.col("segment_key").alias("segment_id"), "segment_code", (F.col("segment_key") % 25).alias("road_id"), F.lit("NB").alias("direction"), (F.col("segment_key") % 25).alias("start_intersection_id"), ((F.col("segment_key") + 7) % 25).alias("end_intersection_id"),
            F.col("length_m").cast("int").alias("length_m"), (F.col("segment_key") % 3 + 1).cast("int").alias("lane_count"), F.col("speed_limit").alias("speed_limit_kmh"), old,
        ),
        "sensor_type": t("region").select(r.alias("sensor_type_id"), text("T", r).alias("type_name"), text("tech", r).alias("technology")),
        "sensor": users.where("not is_camera and k % 17 <> 0").select(text("U", k).alias("serial_number"), (k % 5).alias("sensor_type_id"), (k % 50).alias("segment_id"), F.lit("OK").alias("status"), F.lit("1994-01-01").cast("date").alias("install_date"), F.lit("1.0").alias("firmware_version"), old),
        "vehicle_type": t("events").select(F.upper("event_type").alias("type_code")).distinct().select("type_code", F.initcap("type_code").alias("type_name"), F.lit("Any").alias("category"), F.col("type_code").isin("PURCHASE", "SIGNUP").cast("int").alias("is_heavy"), old),
        "camera": users.where("is_camera").select(text("KU", k).alias("camera_code"), (k % 25).alias("intersection_id"), F.lit("M").alias("model"), F.lit("4k").alias("resolution"), F.lit("2").alias("firmware_version"), F.lit("OK").alias("status"), old),
        "light": t("nation").select(text("L", n).alias("controller_code"), n.alias("intersection_id"), text("P", n % 4).alias("timing_plan"), (n * 5 + 60).cast("int").alias("cycle_seconds"), F.lit("OK").alias("status"), old),
        "incident_type": T.incident_kinds(spark, sf_dir).select(F.col("incident_type_key").alias("incident_type_id"), text("P", F.col("incident_type_key")).alias("type_code"), "type_name", "category", F.lit(2).alias("default_severity"), old),
        "vehicle": t("part").select(F.col("p_partkey").alias("vehicle_id"), F.col("p_brand").alias("make"), F.col("p_type").alias("model")),
        "emergency_vehicle": t("part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("emergency_vehicle_id"), text("E", F.col("p_partkey")).alias("unit_code"), F.lit("Police").alias("unit_type"), F.lit("HQ").alias("home_station"), F.col("p_partkey").alias("vehicle_id"), old),
        "incident": inc.select(
            F.col("incident_number").alias("incident_id"), text("I", F.col("incident_number")).alias("incident_number"), F.col("incident_type_key").alias("incident_type_id"), F.col("segment_key").alias("segment_id"), "detected_ts", "cleared_ts", "closed_ts",
            F.col("current_status").alias("status"), F.col("severity").cast("int").alias("severity"), F.col("lanes_blocked").cast("int").alias("lanes_blocked"), F.col("day").cast("timestamp").alias(CHANGED),
        ),
        "police_response": first.unionByName(first.withColumns({"dispatched_ts": late, "emergency_vehicle_id": F.lit(10).cast("long")})),
        "weather_observation": stations.select(text("w", F.col("st")).alias("station_id"), F.col("day").cast("timestamp").alias("observed_ts"), kinds.alias("condition_code")),
    }


def seed_warehouse(spark: SparkSession, sf_dir: str, kind: str = "seed") -> dict[str, object]:
    """A new warehouse for the tables' span of days, before any night, one a kind: {root, last, dims}. The generated dimensions in dims stay as they are ever after."""
    made, fresh = _once(kind, spark, sf_dir)
    if fresh:
        root, first = fresh_path(spark, "warehouse"), first_day(spark, sf_dir)
        span = T.table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")).alias("lo")).first()
        last = max(T.table(spark, sf_dir, "events").agg(F.max(F.to_date("ts")).alias("d")).first().d, T.incident_source(spark, sf_dir).agg(F.max(F.greatest("detected_ts", "closed_ts")).alias("t")).first().t.date())
        warehouse.seed(spark, root, str(min(span.lo, first)), str(last + timedelta(days=1)))
        made.update(root=root, last=last, dims={name: sinks.current(spark, f"{root}/{name}") for name in warehouse.STATIC})
    return made


def run_warehouse(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    """A warehouse after one night: seeded, loaded from the source tables and the lake's day. {root, day, tables}."""
    made, fresh = _once("warehouse", spark, sf_dir)
    if fresh:
        fed = run_lake(spark, sf_dir)
        seeded = seed_warehouse(spark, sf_dir)
        root, last = seeded["root"], seeded["last"]
        staged, hourly = lake.staged_events(spark, fed["lake"], fed["day"]), lake.staged_hourly(spark, fed["lake"], fed["day"])
        upper = f"{last + timedelta(days=1)} 00:00:00"
        tables = warehouse.run_nightly(spark, root, source_tables(spark, sf_dir), staged, hourly, fed["day"], 1, upper)
        made.update(fed, root=root, tables=tables)
    return made


def run_events(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    """A warehouse with the night's event fact and the dimensions that it looks up, which need no incident, hour or check; the whole
    warehouse, if the session has it: {root, day, tables}."""
    whole, missing = _once("warehouse", spark, sf_dir)
    made, fresh = _once("event fact", spark, sf_dir) if missing else (whole, False)
    if fresh:
        fed = run_lake(spark, sf_dir)
        seeded = seed_warehouse(spark, sf_dir, "seed of events")
        upper = f"{seeded['last'] + timedelta(days=1)} 00:00:00"
        tables = warehouse.run_events(spark, seeded["root"], source_tables(spark, sf_dir), lake.staged_events(spark, fed["lake"], fed["day"]), fed["day"], 1, upper)
        made.update(fed, root=seeded["root"], tables=tables)
    return made
