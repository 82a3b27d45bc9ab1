"""Registered queries of whole jobs: feeds and sinks, the lake's day, the warehouse's night, its checks and views, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import analytics as A
from lakemart.operators import cleanse, dimensions, facts, joins, spines
from lakemart.plans import audit, extracts, lake, samples, semantic
from lakemart.plans import tables as T
from lakemart.plans.bindings import bind, customer_dim
from lakemart.sources import feeds, sinks
from lakemart.sources.scratch import fresh_path

# ---------------------------------------------------------------- the lake

#: raw: all events on one day with their defects; feed: the lines of the sensors' and cameras' feeds; e: the same with what becomes of each.
FEED = """
day AS (SELECT min(event_date) AS d FROM det),
r0 AS (SELECT det.*, d, hour(event_ts) * 3600 + minute(event_ts) * 60 + second(event_ts) AS sec, event_id % 3 = 0 AS cam,
  CASE WHEN event_id % 67 = 0 THEN d + 365 WHEN event_id % 71 = 0 THEN d - 1 ELSE d END AS on_day FROM det, day),
raw AS (SELECT event_id, d, cam, on_day, on_day::TIMESTAMP + to_seconds(sec) AS ts, sec // 3600 AS h, user_id, event_id % 97 <> 0 AS named, CASE WHEN event_id % 101 <> 0 THEN 'S' || user_id % 50 END AS segment_code,
  CASE WHEN event_id % 53 = 0 THEN 'XX' ELSE (['NB', 'SB', 'EB', 'WB'])[event_id % 4 + 1] END AS direction, upper(event_type) AS vehicle_type_code,
  CASE WHEN event_id % 89 = 0 THEN 9990 ELSE ((speed_kmh * 100)::BIGINT + 5) // 10 END AS tenths, CASE WHEN event_id % 61 = 0 THEN 150 ELSE occupancy_pct END AS occ FROM r0),
feed AS (SELECT *, unnest(CASE WHEN NOT cam AND event_id % 83 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM raw),
e AS (SELECT *, CASE WHEN copy = 2 THEN 'DUPLICATE' WHEN NOT named THEN 'MISSING_KEY' WHEN tenths <= 0 OR tenths > 2500 THEN 'SPEED_RANGE' WHEN NOT cam AND (occ < 0 OR occ > 100) THEN 'OCCUPANCY_RANGE'
  WHEN on_day > d + 10 THEN 'FUTURE_TIMESTAMP' WHEN on_day <> d THEN 'DATE_MISMATCH' WHEN direction = 'XX' THEN 'BAD_DIRECTION' END AS reason FROM feed),
good AS (SELECT *, (tenths / 10.0)::DECIMAL(5,1) AS speed_kmh, CASE WHEN cam THEN NULL ELSE occ END AS occupancy_pct FROM e WHERE reason IS NULL),
bad AS (SELECT event_id::VARCHAR AS event_id, reason AS reject_reason FROM e WHERE reason IS NOT NULL UNION ALL SELECT 'bad' || event_id, 'CORRUPT_RECORD' FROM raw WHERE NOT cam AND event_id % 79 = 0),
w0 AS (SELECT DISTINCT h, event_id % 3 AS st, d FROM raw),
obs AS (SELECT 'W' || st AS station_code, d::TIMESTAMP + to_seconds(h * 3600 + 600) AS observed_ts, h, d, ((h * 3 + st * 2) % 40 - 8) AS temperature_c, ((h + st) % 9) AS precipitation_mm, (h * 150 + st * 10)::INT AS visibility_m, (['DRY', 'RAIN', 'FOG', 'SNOW', 'ICE', 'STORM'])[(h + st) % 6 + 1] AS condition_code FROM w0),
wh AS (SELECT h, sum(temperature_c)::DOUBLE / count(*) AS avg_temp_c, sum(precipitation_mm)::DOUBLE / count(*) AS precipitation_mm, min(visibility_m) AS visibility_m,
  (['DRY', 'RAIN', 'FOG', 'SNOW', 'ICE', 'STORM'])[max(list_position(['DRY', 'RAIN', 'FOG', 'SNOW', 'ICE', 'STORM'], condition_code))] AS condition_code FROM obs GROUP BY h)"""


def zone(name: str, *columns: str):
    """A query of one of the lake's datasets of the day."""

    def of(s: SparkSession, d: str) -> DataFrame:
        made = samples.run_lake(s, d)
        return s.read.parquet(f"{made['lake']}/{name}").selectExpr(*columns)

    return of


def bronze(feed: str):
    return lambda s, d: s.read.parquet(f"{samples.run_lake(s, d)['lake']}/bronze/{feed}")


ntz = "cast({0} as timestamp_ntz) as {0}".format
LINES = "SELECT event_id::VARCHAR AS event_id, CASE WHEN named THEN 'u' || user_id END AS sensor_serial, d AS ingest_date, false AS corrupt FROM feed WHERE NOT cam UNION ALL SELECT 'bad' || event_id, 'none', d, true FROM raw WHERE NOT cam AND event_id % 79 = 0"
bind("s1_csv_feed", f", {FEED} {LINES}")(
    lambda s, d: bronze("sensor_readings")(s, d).select("event_id", F.when(F.col("_corrupt_record").isNull(), F.col("sensor_serial")).otherwise("none").alias("sensor_serial"), "ingest_date", F.col("_corrupt_record").isNotNull().alias("corrupt"))
)
bind("s2_camera_json", f", {FEED} SELECT event_id::VARCHAR AS event_id, CASE WHEN named THEN 'ku' || user_id END AS camera_code, ts AS event_ts, (tenths / 10.0)::DECIMAL(5,1) AS speed_kmh FROM raw WHERE cam")(
    lambda s, d: bronze("camera_events")(s, d).selectExpr("event_id", "camera_code", ntz("event_ts"), "detection.speed_kmh as speed_kmh")
)
bind("s3_weather_json", f", {FEED} SELECT lower(station_code) AS station_code, observed_ts, visibility_m, count(*) * (CASE WHEN any_value(h) % 5 = 0 THEN 2 ELSE 1 END) AS n FROM obs GROUP BY ALL")(
    lambda s, d: s.read.parquet(f"{samples.run_weather(s, d)['lake']}/bronze/weather_observations").groupBy("station_code", F.expr(ntz("observed_ts")), "visibility_m").agg(F.count("*").alias("n"))
)


def landed(s: SparkSession, d: str, load_date: str | None = None) -> DataFrame:
    fed = samples.land(s, d)
    return feeds.read_csv_feed(s, feeds.pattern(fed["raw"], "sensor_readings", "csv", load_date), batch_id=7)


bind("s4_date_glob", f", {FEED} SELECT d AS ingest_date, count(*) AS n FROM ({LINES}) x, day GROUP BY d UNION ALL SELECT d + 1, count(*) FROM raw WHERE NOT cam AND event_id % 10 = 0 GROUP BY d")(
    lambda s, d: landed(s, d).groupBy("ingest_date").agg(F.count("*").alias("n"))
)
bind("s5_ingest_date", f", {FEED} SELECT d AS ingest_date, on_day AS event_date, count(*) AS n FROM feed WHERE NOT cam GROUP BY ALL")(
    lambda s, d: landed(s, d, samples.land(s, d)["day"]).where("_corrupt_record is null").groupBy("ingest_date", "event_date").agg(F.count("*").alias("n"))
)
bind("s6_audit_columns", f", {FEED} SELECT 'sensor' AS _source, 7 AS _batch_id, true AS has_file, true AS has_time, count(*) AS n FROM ({LINES})")(
    lambda s, d: landed(s, d, samples.land(s, d)["day"]).groupBy("_source", "_batch_id", F.col("_source_file").contains("sensor_readings_").alias("has_file"), F.col("_ingest_ts").isNotNull().alias("has_time")).agg(F.count("*").alias("n"))
)
bind("s7_read_zone", f", {FEED} SELECT event_id::VARCHAR AS event_id FROM good")(lambda s, d: (lambda m: feeds.read_zone(s, f"{m['lake']}/silver/events", "event_date", m["day"]).select("event_id"))(samples.run_lake(s, d)))
bind("s8_incremental_extract", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-06-01'", False)(
    lambda s, d: feeds.incremental_extract(T.table(s, d, "orders"), "o_orderdate", F.lit("1996-01-01").cast("timestamp"), F.lit("1998-06-01").cast("timestamp")).select("o_orderkey")
)
bind("s9_advance_watermarks", "SELECT 'customer' AS table_name, TIMESTAMP '1990-01-01' AS last_value UNION ALL SELECT 'orders', max(o_orderdate) FROM orders", False)(
    lambda s, d: feeds.advance_watermarks(
        T.table(s, d, "orders").limit(1).select(F.explode(F.array(F.lit("orders"), F.lit("customer"))).alias("table_name"), F.lit("1990-01-01").cast("timestamp").alias("last_value")), "orders", T.table(s, d, "orders").agg(F.max("o_orderdate").alias("t")).first().t
    ).selectExpr("table_name", ntz("last_value"))
)


def manifest(s: SparkSession, d: str) -> DataFrame:
    """Counts of the feeds' lines by day, written as a manifest beside them and read back."""
    fed = samples.land(s, d)
    lines = landed(s, d).groupBy(F.col("ingest_date").alias("date")).agg(F.count("*").alias("sensor_csv_rows"))
    rows = lines.withColumn("camera_events", F.lit(0).cast("long"))
    path = f"{fresh_path(s, 'manifest')}"
    rows.agg(F.to_json(F.collect_list(F.struct("date", "sensor_csv_rows", "camera_events"))).alias("text")).coalesce(1).write.option("compression", "none").text(path)  # a row a day
    (part,) = [x for x in s.read.text(path).inputFiles()]
    assert fed
    return feeds.read_manifest(s, part)


bind("s10_manifest", f", {FEED} SELECT d AS date, count(*) AS sensor_csv_rows, 0::BIGINT AS camera_events FROM ({LINES}) x, day GROUP BY d UNION ALL SELECT d + 1, count(*), 0 FROM raw WHERE NOT cam AND event_id % 10 = 0 GROUP BY d")(manifest)


def by_day(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    path = fresh_path(s, "by-day")
    rows = T.detections(s, d).select("event_id", "event_ts", "segment_code", "event_date")
    sinks.write_partitioned(rows, path, "event_date", sort=("segment_code", "event_ts"))
    return rows, path


bind("k1_write_partitioned", "SELECT event_id, segment_code, event_date FROM det")(lambda s, d: s.read.parquet(by_day(s, d)[1]).select("event_id", "segment_code", "event_date"))
bind("k4_write_full", "SELECT segment_code, count(*) AS n FROM det WHERE event_id % 2 = 0 GROUP BY 1")(lambda s, d: _rewritten(s, d))


def _rewritten(s: SparkSession, d: str) -> DataFrame:
    """A dataset written whole twice: the second time stands."""
    path = fresh_path(s, "full")
    for rows in (T.detections(s, d), T.detections(s, d).where("event_id % 2 = 0")):
        sinks.write_full(rows.groupBy("segment_code").agg(F.count("*").alias("n")), path)
    return s.read.parquet(path)


def replaced(s: SparkSession, d: str) -> DataFrame:
    """Of a dataset by date the first date is replaced by half of its rows, the next by none."""
    rows, path = by_day(s, d)
    one, two = [r.event_date for r in rows.select("event_date").distinct().orderBy("event_date").limit(2).collect()]
    sinks.replace_slice(rows.where("event_id % 2 = 0"), path, "event_date", one)
    sinks.replace_slice(rows.limit(0), path, "event_date", two)
    return s.read.parquet(path).select("event_id", "event_date")


bind("k7_replace_slice", "WITH k AS (SELECT event_date, dense_rank() OVER (ORDER BY event_date) AS n FROM (SELECT DISTINCT event_date FROM det)) SELECT event_id, event_date FROM det JOIN k USING (event_date) WHERE n > 2 OR n = 1 AND event_id % 2 = 0")(replaced)
SILVER = "event_id::VARCHAR AS event_id, ts AS event_ts, CASE WHEN cam THEN 'CAMERA' ELSE 'SENSOR' END AS detector_type, CASE WHEN cam THEN 'KU' || user_id ELSE 'U' || user_id END AS detector_code, CASE WHEN NOT cam THEN 'U' || user_id END AS sensor_serial, CASE WHEN cam THEN 'KU' || user_id END AS camera_code, segment_code, direction, vehicle_type_code, speed_kmh"
EVENT = ("event_id", ntz("event_ts"), "detector_type", "detector_code", "sensor_serial", "camera_code", "segment_code", "direction", "vehicle_type_code", "speed_kmh")
bind("p2_conformed_feeds", f", {FEED} SELECT {SILVER} FROM good")(zone("silver/events", *EVENT))
bind("k2_silver_events", f", {FEED} SELECT d AS event_date, segment_code, count(*) AS n, sum(speed_kmh)::DECIMAL(15,1) AS speed FROM good GROUP BY ALL")(
    lambda s, d: s.read.parquet(f"{samples.run_lake(s, d)['lake']}/silver/events").groupBy("event_date", "segment_code").agg(F.count("*").alias("n"), F.sum("speed_kmh").alias("speed"))
)
bind("u1_union_feeds", f", {FEED} SELECT cam AS is_camera, count(*) AS n FROM good GROUP BY 1")(lambda s, d: zone("silver/events", "detector_type")(s, d).groupBy((F.col("detector_type") == "CAMERA").alias("is_camera")).agg(F.count("*").alias("n")))
bind("k3_quarantine", f", {FEED} SELECT event_id, reject_reason FROM bad")(zone("silver/quarantine", "event_id", "reject_reason"))
bind("p3_corrupt_rows", f", {FEED} SELECT 'bad' || event_id AS event_id, 'SENSOR' AS detector_type, 'bad' || event_id || ',what' AS raw_line, d AS ingest_date FROM raw WHERE NOT cam AND event_id % 79 = 0")(
    lambda s, d: s.read.parquet(f"{samples.run_lake(s, d)['lake']}/silver/quarantine").where("reject_reason = 'CORRUPT_RECORD'").select("event_id", "detector_type", "raw_line", "ingest_date")
)
bind("d3_weather_dedup", f", {FEED} SELECT station_code, observed_ts, condition_code, temperature_c::DECIMAL(4,1) AS temperature_c, visibility_m FROM obs")(
    lambda s, d: s.read.parquet(f"{samples.run_weather(s, d)['lake']}/silver/weather").selectExpr("station_code", ntz("observed_ts"), "condition_code", "temperature_c", "visibility_m")
)
bind("a1_weather_hourly", f", {FEED} SELECT d AS event_date, h AS hour_of_day, round(avg_temp_c, 3) AS avg_temp_c, round(precipitation_mm, 3) AS precipitation_mm, visibility_m, condition_code FROM wh, day")(
    lambda s, d: A.weather_hourly(s.read.parquet(f"{samples.run_weather(s, d)['lake']}/silver/weather")).select("event_date", "hour_of_day", F.round("avg_temp_c", 3).cast("double").alias("avg_temp_c"), F.round("precipitation_mm", 3).cast("double").alias("precipitation_mm"), "visibility_m", "condition_code")
)
bind("j1_weather_join", f", {FEED} SELECT event_id::VARCHAR AS event_id, condition_code, visibility_m FROM good LEFT JOIN wh USING (h)")(zone("gold/traffic_events", "event_id", "condition_code", "visibility_m"))
bind("k4_gold_hourly", f", {FEED} SELECT d AS event_date, h AS hour_of_day, segment_code, count(*) AS vehicle_count, count(*) FILTER (vehicle_type_code IN ('TRK', 'ART', 'BUS')) AS heavy_vehicle_count, (quantile_disc(tenths, 0.85) / 10.0)::DECIMAL(7,1) AS p85_speed FROM good WHERE segment_code IS NOT NULL GROUP BY ALL")(
    zone("gold/hourly_traffic", "event_date", "hour_of_day", "segment_code", "vehicle_count", "heavy_vehicle_count", "cast(p85_speed as decimal(7,1)) as p85_speed")
)
bind("a5_first_in_group", f", {FEED} SELECT DISTINCT h AS hour_of_day, segment_code, condition_code, visibility_m FROM good LEFT JOIN wh USING (h) WHERE segment_code IS NOT NULL")(zone("gold/hourly_traffic", "hour_of_day", "segment_code", "condition_code", "visibility_m"))
bind("k6_staging", f", {FEED} SELECT event_id::VARCHAR AS event_id, d AS ingest_date, condition_code FROM good LEFT JOIN wh USING (h)")(
    lambda s, d: (lambda m: lake.staged_events(s, m["lake"], m["day"]).select("event_id", "ingest_date", "condition_code"))(samples.run_lake(s, d))
)
bind("r0_ingest_stats", f", {FEED} SELECT count(*) AS total, count(*) FILTER (corrupt) AS corrupt, (SELECT count(*) FROM feed WHERE NOT cam AND on_day <> d) + count(*) FILTER (corrupt) AS other_date FROM ({LINES})")(
    lambda s, d: cleanse.ingest_stats(landed(s, d, samples.land(s, d)["day"]))
)
bind("r2_zone_reconciliation", f", {FEED}, n AS (SELECT (SELECT count(*) FROM feed) + (SELECT count(*) FROM raw WHERE NOT cam AND event_id % 79 = 0) AS b, (SELECT count(*) FROM good WHERE segment_code IS NOT NULL) AS g, (SELECT count(*) FROM good) AS s) SELECT 'bronze_is_silver' AS check_name, b AS left_rows, b AS right_rows, true AS balanced FROM n UNION ALL SELECT 'gold_within_silver', g, s, true FROM n")(
    lambda s, d: lake.reconcile(s, samples.run_lake(s, d)["lake"])
)
bind("x2_gold_summary", f", {FEED}, g AS (SELECT h, segment_code, count(*) AS n FROM good WHERE segment_code IS NOT NULL GROUP BY ALL) SELECT count(*) AS segment_hours, sum(n)::BIGINT AS total_vehicles, count(DISTINCT segment_code) AS segments FROM g")(
    lambda s, d: semantic.gold_summary(s.read.parquet(f"{samples.run_lake(s, d)['lake']}/gold/hourly_traffic")).drop("avg_speed")
)
bind("x2_rules_fired", f", {FEED} SELECT k.r AS reject_reason, count(bad.event_id) AS rejected_rows, CASE WHEN count(bad.event_id) > 0 THEN 'FIRED' ELSE 'ARMED' END AS status FROM (SELECT unnest(['CORRUPT_RECORD', 'SPEED_RANGE', 'NEVER']) AS r) k LEFT JOIN bad ON bad.reject_reason = k.r GROUP BY 1")(
    lambda s, d: (lambda q: semantic.rules_fired(q, q.agg(F.array(*[F.lit(x) for x in ("CORRUPT_RECORD", "SPEED_RANGE", "NEVER")]).alias("r")).select(F.explode("r").alias("reject_reason"))))(s.read.parquet(f"{samples.run_lake(s, d)['lake']}/silver/quarantine"))
)
bind("r6_stale_partitions", "WITH k AS (SELECT DISTINCT event_date FROM det) SELECT event_date AS day, count(*) AS rows FROM det WHERE day(event_date) % 7 = 0 GROUP BY 1")(
    lambda s, d: (lambda t: audit.stale_partitions(t, "event_date", t.where("day(event_date) % 7 <> 0").select("event_date").distinct(), "event_date"))(T.detections(s, d))
)

# ---------------------------------------------------------------- the source system's extracts

#: src: the source tables in SQL, as `samples.source_tables` has them.
SOURCE = """
rs AS (SELECT segment_key AS segment_id, segment_code, segment_key % 25 AS a, (segment_key + 7) % 25 AS b, length_m, segment_key % 3 + 1 AS lane_count, speed_limit FROM seg),
us AS (SELECT DISTINCT user_id AS k, event_id % 3 = 0 AS cam FROM events),
xseg AS (SELECT segment_code, 'R' || a AS road_code, n_name AS road_name, r_name AS city, (SELECT 'D ' || r_name FROM region WHERE r_regionkey = a % 5) AS district, 'X' || a AS start_intersection, 'X' || b AS end_intersection,
  (a + 40)::DECIMAL(9,6) AS latitude, length_m, lane_count, speed_limit FROM rs JOIN nation ON n_nationkey = a JOIN region ON r_regionkey = n_regionkey),
xsen AS (SELECT 'U' || k AS serial_number, 'T' || (k % 5) AS sensor_type_name, 'tech' || (k % 5) AS technology, 'S' || (k % 50) AS segment_code FROM us WHERE NOT cam AND k % 17 <> 0 AND k % 50 IN (SELECT segment_id FROM rs)),
xcam AS (SELECT 'KU' || k AS camera_code, 'X' || (k % 25) AS intersection_name FROM us WHERE cam),
xlight AS (SELECT 'L' || n_nationkey AS controller_code, 'X' || n_nationkey AS intersection_name, 'P' || (n_nationkey % 4) AS current_timing_plan, n_nationkey * 5 + 60 AS cycle_seconds FROM nation),
xtype AS (SELECT 'P' || incident_type_key AS type_code, type_name, category FROM kind),
xunit AS (SELECT 'E' || p_partkey AS unit_code, p_brand AS vehicle_make, p_type AS vehicle_model FROM part WHERE p_partkey % 10 = 0),
xveh AS (SELECT DISTINCT upper(event_type) AS type_code FROM events),
seen AS (SELECT DISTINCT detected_ts::DATE AS day, incident_number % 3 AS st FROM fil),
one AS (SELECT day::TIMESTAMP AS at, (['DRY', 'RAIN', 'FOG', 'SNOW', 'ICE', 'STORM'])[(dayofyear(day) + min(st)) % 6 + 1] AS condition_code FROM seen GROUP BY day),
xinc AS (SELECT 'I' || incident_number AS incident_number, 'P' || incident_type_key AS incident_type_code, segment_key, 'S' || segment_key AS segment_code, CASE WHEN dispatched_ts IS NOT NULL AND incident_number % 20 * 10 + 10 IN (SELECT p_partkey FROM part) THEN 'E' || (incident_number % 20 * 10 + 10) END AS unit_code,
  one.condition_code, detected_ts, dispatched_ts, arrived_ts, cleared_ts, closed_ts, detected_date_key FROM fil ASOF LEFT JOIN one ON fil.detected_ts >= one.at WHERE segment_key IN (SELECT segment_id FROM rs))"""


def extract(name: str, *columns: str):
    def of(s: SparkSession, d: str) -> DataFrame:
        tables = samples.source_tables(s, d)
        source, denormalise = extracts.EXTRACTS[name]
        return denormalise(tables[source], tables).selectExpr(*columns)

    return of


bind("j8_segment_extract", f", {SOURCE} SELECT * FROM xseg")(extract("segment", "segment_code", "road_code", "road_name", "city", "district", "start_intersection", "end_intersection", "latitude", "cast(length_m as long) as length_m", "cast(lane_count as long) as lane_count", "cast(speed_limit as long) as speed_limit"))
bind("j9_sensor_extract", f", {SOURCE} SELECT * FROM xsen")(extract("sensor", "serial_number", "sensor_type_name", "technology", "segment_code"))
bind("j9_camera_extract", f", {SOURCE} SELECT * FROM xcam")(extract("camera", "camera_code", "intersection_name"))
bind("j9_light_extract", f", {SOURCE} SELECT * FROM xlight")(extract("light", "controller_code", "intersection_name", "current_timing_plan", "cycle_seconds"))
bind("j9_unit_extract", f", {SOURCE} SELECT * FROM xunit")(extract("unit", "unit_code", "vehicle_make", "vehicle_model"))
bind("j9_incident_extract", f", {SOURCE} SELECT incident_number, incident_type_code, segment_code, unit_code, condition_code, detected_ts, dispatched_ts FROM xinc")(extract("incident", "incident_number", "incident_type_code", "segment_code", "unit_code", "condition_code", "detected_ts", "dispatched_ts"))
bind("s8_all_extracts", f", {SOURCE} SELECT 'segment' AS label, count(*) AS n FROM xseg UNION ALL SELECT 'sensor', count(*) FROM xsen UNION ALL SELECT 'vehicle_type', 0 UNION ALL SELECT 'camera', count(*) FROM xcam UNION ALL SELECT 'light', count(*) FROM xlight UNION ALL SELECT 'incident_type', count(*) FROM xtype UNION ALL SELECT 'unit', count(*) FROM xunit UNION ALL SELECT 'incident', count(*) FROM xinc WHERE detected_ts::DATE > DATE '1996-01-01' AND detected_ts::DATE <= DATE '1998-06-01'")(
    lambda s, d: cleanse.labelled_union({
        k: x.agg(F.count("*").alias("n")) for k, x in extracts.changed(samples.source_tables(s, d), {"incident": "1996-01-01 00:00:00", "vehicle_type": "1995-01-01 00:00:00"}, F.lit("1998-06-01 00:00:00").cast("timestamp")).items()
    })
)

# ---------------------------------------------------------------- the warehouse's night


def night(name: str, *columns: str):
    """A query of one of the warehouse's tables after the night."""
    return lambda s, d: samples.run_warehouse(s, d)["tables"][name].selectExpr(*columns)


#: Dimensions by name after the night, with the events' and hours' facts by business key.
NIGHT = f"""{FEED}, {SOURCE},
known AS (SELECT serial_number FROM xsen), vt AS (SELECT type_code FROM xveh),
dseg AS (SELECT segment_code, speed_limit, false AS is_inferred FROM xseg UNION ALL SELECT DISTINCT segment_code, NULL, true FROM good WHERE segment_code IS NOT NULL AND segment_code NOT IN (SELECT segment_code FROM xseg)),
dsen AS (SELECT serial_number, false AS is_inferred FROM xsen UNION ALL SELECT DISTINCT 'U' || user_id, true FROM good WHERE NOT cam AND 'U' || user_id NOT IN (SELECT serial_number FROM known)),
f AS (SELECT event_id::VARCHAR AS event_id, strftime(d, '%Y%m%d')::INT AS date_key, (h * 60 + minute(ts))::INT AS time_key, segment_code, CASE WHEN NOT cam THEN 'U' || user_id END AS serial_number, CASE WHEN cam THEN 'KU' || user_id END AS camera_code, vehicle_type_code,
  CASE WHEN cam THEN 'CAMERA' ELSE 'SENSOR' END AS detector_type, speed_kmh, h FROM good),
hr AS (SELECT segment_code, h, count(*) AS n, sum(tenths) AS tenths FROM good WHERE segment_code IS NOT NULL GROUP BY ALL),
warned AS (SELECT (SELECT count(*) FROM good WHERE segment_code IS NULL) AS unknown, (SELECT count(*) FROM hr JOIN xseg USING (segment_code) WHERE (2 * tenths + n) // (2 * n) > 15 * speed_limit) AS fast)"""
UNKNOWN = "coalesce(nullif({c}, ''), 'Unknown')"


def fact_event(s: SparkSession, d: str) -> DataFrame:
    """The event fact with its keys turned back into codes through the dimensions."""
    t = samples.run_events(s, d)["tables"]
    out = t["fte"]
    for dim, key, code in (("segment", "segment_key", "segment_code"), ("sensor", "sensor_key", "serial_number"), ("camera", "camera_key", "camera_code"), ("vehicle_type", "vehicle_type_key", "type_code")):
        out = out.join(t[dim].select(key, code), key)
    out = out.join(t["weather"].select("weather_key", "condition_code"), "weather_key")
    return out.select("event_id", "date_key", "time_key", "segment_code", "serial_number", "camera_code", F.col("type_code").alias("vehicle_type_code"), "condition_code", "detector_type", F.col("speed_over_limit_kmh").cast("double").alias("over"))


bind("f1_event_fact", f", {NIGHT} SELECT event_id, date_key, time_key, coalesce(segment_code, 'Unknown') AS segment_code, coalesce(serial_number, 'Unknown') AS serial_number, coalesce(camera_code, 'Unknown') AS camera_code, vehicle_type_code, condition_code, detector_type, (speed_kmh - speed_limit)::DOUBLE AS over FROM f LEFT JOIN dseg USING (segment_code) LEFT JOIN wh USING (h)")(fact_event)
BANDS = "CASE WHEN avg_temp_c < -5 THEN 'Below -5' WHEN avg_temp_c < 5 THEN '-5 to 5' WHEN avg_temp_c < 15 THEN '5 to 15' WHEN avg_temp_c < 25 THEN '15 to 25' ELSE 'Above 25' END AS temp_band, CASE WHEN precipitation_mm = 0 THEN 'None' WHEN precipitation_mm < 2.5 THEN 'Light' WHEN precipitation_mm < 7.5 THEN 'Moderate' ELSE 'Heavy' END AS precip_band, CASE WHEN visibility_m < 500 THEN 'Poor' WHEN visibility_m < 2000 THEN 'Reduced' ELSE 'Good' END AS visibility_band"
bind("j5_weather_lookup", f", {NIGHT} SELECT event_id, condition_code, {BANDS} FROM f JOIN wh USING (h)")(
    lambda s, d: (lambda t: t["fte"].join(t["weather"], "weather_key").select("event_id", "condition_code", "temp_band", "precip_band", "visibility_band"))(samples.run_events(s, d)["tables"])
)


def fact_hourly(s: SparkSession, d: str) -> DataFrame:
    t = samples.run_warehouse(s, d)["tables"]
    named = t["fht"].join(t["segment"].select("segment_key", "segment_code"), ["segment_key", "segment_code"]).join(t["weather"].select("weather_key", "condition_code", "precip_band"), "weather_key")
    return named.select("date_key", "hour_of_day", "segment_code", "vehicle_count", "condition_code", "precip_band", "incident_count", F.col("congestion_index").isNotNull().alias("has_congestion"))


bind("f2_hourly_snapshot", f", {NIGHT}, sp AS (SELECT d, dseg.segment_code, speed_limit, r.h FROM dseg, range(24) r(h), day) SELECT strftime(d, '%Y%m%d')::INT AS date_key, h::INT AS hour_of_day, segment_code, coalesce(n, 0)::BIGINT AS vehicle_count, CASE WHEN n IS NULL THEN 'UNK' ELSE condition_code END AS condition_code, CASE WHEN n IS NULL THEN 'Unknown' ELSE (SELECT CASE WHEN precipitation_mm = 0 THEN 'None' WHEN precipitation_mm < 2.5 THEN 'Light' WHEN precipitation_mm < 7.5 THEN 'Moderate' ELSE 'Heavy' END) END AS precip_band, 0::BIGINT AS incident_count, n IS NOT NULL AND speed_limit IS NOT NULL AS has_congestion FROM sp LEFT JOIN hr USING (segment_code, h) LEFT JOIN wh USING (h)")(fact_hourly)
bind("f3_incident_fact", f", {NIGHT} SELECT incident_number, incident_type_code, coalesce(unit_code, 'Unknown') AS unit_code, CASE WHEN condition_code IS NULL THEN 'UNK' ELSE condition_code END AS condition_code, CASE WHEN detected_ts::DATE >= d THEN segment_code ELSE 'Unknown' END AS segment_code, detected_date_key FROM xinc, day")(
    lambda s, d: (lambda t: t["fil"].join(t["incident_type"].select("incident_type_key", F.col("type_code").alias("incident_type_code")), "incident_type_key").join(t["unit"].select("unit_key", "unit_code"), "unit_key").join(t["weather"].select("weather_key", "condition_code"), "weather_key").join(t["segment"].select("segment_key", "segment_code"), "segment_key").select("incident_number", "incident_type_code", "unit_code", "condition_code", "segment_code", "detected_date_key"))(samples.run_warehouse(s, d)["tables"])
)
bind("c8_dimension_load", f", {NIGHT} SELECT 'segment' AS label, segment_code AS code, is_inferred FROM dseg UNION ALL SELECT 'sensor', serial_number, is_inferred FROM dsen UNION ALL SELECT 'camera', camera_code, false FROM xcam UNION ALL SELECT 'light', controller_code, false FROM xlight UNION ALL SELECT 'unit', unit_code, false FROM xunit UNION ALL SELECT 'vehicle_type', type_code, false FROM xveh UNION ALL SELECT 'incident_type', type_code, false FROM xtype")(
    lambda s, d: (lambda t: cleanse.labelled_union({
        k: t[k].where(F.col(key) != -1).select(F.col(code).alias("code"), (F.col("is_inferred") if k in ("segment", "sensor") else F.lit(False)).alias("is_inferred"))
        for k, key, code in (("segment", "segment_key", "segment_code"), ("sensor", "sensor_key", "serial_number"), ("camera", "camera_key", "camera_code"), ("light", "light_key", "controller_code"), ("unit", "unit_key", "unit_code"), ("vehicle_type", "vehicle_type_key", "type_code"), ("incident_type", "incident_type_key", "type_code"))
    }))(samples.run_warehouse(s, d)["tables"])
)
STEPS = """
x(step, e, i, u, r) AS (
  SELECT 'Extract.segment', count(*), NULL, NULL, NULL FROM xseg UNION ALL SELECT 'Extract.sensor', count(*), NULL, NULL, NULL FROM xsen UNION ALL SELECT 'Extract.vehicle_type', count(*), NULL, NULL, NULL FROM xveh
  UNION ALL SELECT 'Extract.camera', count(*), NULL, NULL, NULL FROM xcam UNION ALL SELECT 'Extract.light', count(*), NULL, NULL, NULL FROM xlight UNION ALL SELECT 'Extract.incident_type', count(*), NULL, NULL, NULL FROM xtype
  UNION ALL SELECT 'Extract.unit', count(*), NULL, NULL, NULL FROM xunit UNION ALL SELECT 'Extract.incident', count(*), NULL, NULL, NULL FROM xinc
  UNION ALL SELECT 'Dim.segment (SCD2)', count(*), count(*), 0, NULL FROM xseg UNION ALL SELECT 'Dim.sensor (SCD2)', count(*), count(*), 0, NULL FROM xsen UNION ALL SELECT 'Dim.vehicle_type', count(*), count(*), 0, NULL FROM xveh
  UNION ALL SELECT 'Dim.camera', count(*), count(*), 0, NULL FROM xcam UNION ALL SELECT 'Dim.light', count(*), count(*), 0, NULL FROM xlight UNION ALL SELECT 'Dim.incident_type', count(*), count(*), 0, NULL FROM xtype UNION ALL SELECT 'Dim.unit', count(*), count(*), 0, NULL FROM xunit
  UNION ALL SELECT 'InferredMembers.segment', NULL, count(*), NULL, NULL FROM dseg WHERE is_inferred UNION ALL SELECT 'InferredMembers.sensor', NULL, count(*), NULL, NULL FROM dsen WHERE is_inferred
  UNION ALL SELECT 'Fact.TrafficEvent', count(*), count(*), 0, 0 FROM f UNION ALL SELECT 'Fact.IncidentLifecycle', count(*), NULL, NULL, NULL FROM xinc
  UNION ALL SELECT 'Fact.HourlyTraffic', (SELECT count(*) FROM hr), 24 * count(*), NULL, NULL FROM dseg UNION ALL SELECT 'AdvanceWatermarks', NULL, NULL, 8, NULL)"""
VERDICT = "CASE WHEN step = 'Fact.TrafficEvent' THEN 'OK' WHEN step = 'Fact.HourlyTraffic' THEN 'OK (dense)' WHEN step LIKE '%(SCD2)' THEN 'OK (subset)' WHEN step LIKE 'Infer%' OR step LIKE 'Adv%' THEN 'OK (n/a)' ELSE 'OK (staged)' END"
COUNTS = "e::BIGINT AS rows_extracted, i::BIGINT AS rows_inserted, u::BIGINT AS rows_updated, r::BIGINT AS rows_rejected"
bind("f6_nightly", f", {NIGHT}, {STEPS} SELECT step, {COUNTS} FROM x")(night("rowlog", "step", "rows_extracted", "rows_inserted", "rows_updated", "rows_rejected"))
bind("r3_step_verdicts", f", {NIGHT}, {STEPS} SELECT step, {VERDICT} AS verdict FROM x")(lambda s, d: audit.validate_batch(samples.run_warehouse(s, d)["tables"]["rowlog"]).select("step", "verdict"))
bind("r4_batch_log", "SELECT 1::BIGINT AS batch_id, 'NightlyWarehouseRefresh' AS pipeline, min(event_date) AS load_date, 'Succeeded' AS status FROM det")(night("batches", "batch_id", "pipeline", "load_date", "status"))


def summary(s: SparkSession, d: str) -> DataFrame:
    t = samples.run_warehouse(s, d)["tables"]
    return audit.execution_summary(t["batches"], t["rowlog"], t["quality_log"], t).where("seq not in (10, 13)").select("metric", "value")


NUMBER = "format('{:,}', n)"
bind("r5_execution_summary", f", {NIGHT}, m AS (SELECT 'Batches executed' AS metric, '1' AS value UNION ALL SELECT 'Batches succeeded / failed', '1 / 0' UNION ALL SELECT 'Traffic events loaded', {NUMBER} FROM (SELECT count(*) AS n FROM f) UNION ALL SELECT 'Hourly snapshot rows', {NUMBER} FROM (SELECT 24 * count(*) AS n FROM dseg) UNION ALL SELECT 'Incidents tracked', {NUMBER} FROM (SELECT count(*) AS n FROM xinc) UNION ALL SELECT 'Active sensors', {NUMBER} FROM (SELECT count(*) AS n FROM dsen) UNION ALL SELECT 'Active road segments', {NUMBER} FROM (SELECT count(*) AS n FROM dseg) UNION ALL SELECT 'Rows rejected', '0' UNION ALL SELECT 'Inferred members created', {NUMBER} FROM (SELECT (SELECT count(*) FROM dsen WHERE is_inferred) + (SELECT count(*) FROM dseg WHERE is_inferred) AS n) UNION ALL SELECT 'SCD2 versions created', '0' UNION ALL SELECT 'Quality checks passed / failed', (40 - (unknown > 0)::INT - (fast > 0)::INT) || ' / ' || ((unknown > 0)::INT + (fast > 0)::INT) FROM warned) SELECT * FROM m")(summary)
bind("r5_rejects_by_reason", f", {FEED} SELECT reject_reason, count(*) AS rejected_rows FROM bad GROUP BY 1")(
    lambda s, d: (lambda q, b: audit.rejects_by_reason(q.withColumn("batch_id", F.lit(1).cast("long")), b).drop("first_event_date", "last_event_date"))(s.read.parquet(f"{samples.run_lake(s, d)['lake']}/silver/quarantine"), samples.run_warehouse(s, d)["tables"]["batches"])
)
bind("b19_etl_batches", f", {NIGHT}, {STEPS} SELECT 1::BIGINT AS batch_id, (SELECT strftime(d, '%Y%m%d')::INT FROM day) AS date_key, sum(e)::BIGINT AS rows_extracted, sum(i)::BIGINT AS rows_inserted, sum(u)::BIGINT AS rows_updated, sum(r)::BIGINT AS rows_rejected FROM x")(
    lambda s, d: (lambda t: semantic.bi_etl_batches(t["batches"], t["rowlog"]).select("batch_id", "date_key", "rows_extracted", "rows_inserted", "rows_updated", "rows_rejected"))(samples.run_warehouse(s, d)["tables"])
)
bind("b20_quality_checks", f", {NIGHT} SELECT 40::BIGINT AS checks, (SELECT min(date_key) FROM det) AS date_key, ((unknown > 0)::INT + (fast > 0)::INT)::BIGINT AS failed FROM warned")(
    lambda s, d: (lambda t: semantic.bi_quality_checks(t["quality_log"], t["batches"]).groupBy("date_key").agg(F.count("*").alias("checks"), F.count_if(F.col("status") != "Pass").alias("failed")))(samples.run_warehouse(s, d)["tables"])
)
bind("q_report_summary", f", {NIGHT} SELECT 1::BIGINT AS batch_id, 40::BIGINT AS checks_run, (40 - (unknown > 0)::INT - (fast > 0)::INT)::BIGINT AS passed, 0::BIGINT AS failed_errors, ((unknown > 0)::INT + (fast > 0)::INT)::BIGINT AS failed_warnings, 'PASS' AS gate_result FROM warned")(
    lambda s, d: audit.quality_summary(samples.run_warehouse(s, d)["tables"]["quality_log"]).select("batch_id", "checks_run", "passed", "failed_errors", "failed_warnings", "gate_result")
)



def planted_log(s: SparkSession, d: str) -> DataFrame:
    """A log of each detection that is too fast as a failed check: errors for sensors, warnings for cameras, and a pass for those that aren't."""
    fast = F.col("speed_kmh") > 50
    log = T.detections(s, d).groupBy("date_key", "detector_type").agg(F.count_if(fast).alias("failed_rows"))
    status, severity = F.when(F.col("failed_rows") > 2, "Fail").otherwise("Pass"), F.when(F.col("detector_type") == "SENSOR", "Error").otherwise("Warning")
    return log.select(F.lit(1).alias("batch_id"), F.concat_ws("-", "detector_type", "date_key").alias("check_name"), F.lit("Speed").alias("category"), severity.alias("severity"), status.alias("status"), "failed_rows", F.lit("2026-01-01").cast("timestamp").alias("checked_at"))


LOGGED = "log AS (SELECT detector_type || '-' || date_key AS check_name, CASE WHEN detector_type = 'SENSOR' THEN 'Error' ELSE 'Warning' END AS severity, CASE WHEN count(*) FILTER (speed_kmh > 50) > 2 THEN 'Fail' ELSE 'Pass' END AS status FROM det GROUP BY date_key, detector_type)"


def reported(s: SparkSession, d: str) -> DataFrame:
    """The report with the place that each row has in it: rows are taken in the order the report gives."""
    return audit.quality_report(planted_log(s, d)).coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1).select("place", "check_name", "severity", "status")


def gated(s: SparkSession, d: str) -> DataFrame:
    """Which checks close the gate: what assert_quality says, as rows."""
    try:
        audit.assert_quality(planted_log(s, d))
        names = []
    except ValueError as e:
        names = str(e).split(": ", 1)[1].split(", ")
    return s.createDataFrame([(n,) for n in names], "check_name string")


def own_rule(s: SparkSession, d: str) -> DataFrame:
    """A user's rule beside the library's, and what it rejects."""
    rules = [*C.boundary_rules(), C.Rule("TOO_SLOW", F.col("speed_kmh") < 20)]
    return cleanse.apply_rules(lake.conformed_bronze(s, samples.run_lake(s, d)["lake"], samples.run_lake(s, d)["day"]), rules).dropDuplicates(["event_id"]).select("event_id", "reject_reason")


bind("t7_report_order", f", {LOGGED} SELECT row_number() OVER (ORDER BY status <> 'Fail', CASE WHEN status = 'Fail' THEN severity <> 'Error' END, check_name) AS place, check_name, severity, status FROM log")(reported)
bind("ext_own_rule", f", {FEED} SELECT event_id::VARCHAR AS event_id, CASE WHEN NOT named THEN 'MISSING_KEY' WHEN tenths <= 0 OR tenths > 2500 THEN 'SPEED_RANGE' WHEN NOT cam AND (occ < 0 OR occ > 100) THEN 'OCCUPANCY_RANGE' WHEN on_day <> d THEN 'DATE_MISMATCH' WHEN tenths < 200 THEN 'TOO_SLOW' END AS reject_reason FROM raw")(own_rule)
bind("q_gate", f", {LOGGED} SELECT check_name FROM log WHERE severity = 'Error' AND status = 'Fail'")(gated)

# ---------------------------------------------------------------- views over the warehouse

VERSION = "true AS is_current, 1 AS version_number, is_inferred"
#: View -> (dimension, its key, the code that keys are given by, its rows without the unknown member); keys follow the code, inferred members last.
SHOWN = {
    "road_segment": ("segment", "segment_key", "segment_code", f"""SELECT dseg.segment_code, road_code, road_name, 'C' || (substr(road_code, 2)::INT % 3) AS road_category, city, district, CASE WHEN NOT is_inferred THEN 'NB' END AS direction, start_intersection, end_intersection,
  latitude::DOUBLE AS latitude, latitude::DOUBLE - 20 AS longitude, length_m::INT AS length_m, lane_count::INT AS lane_count, xseg.speed_limit::INT AS speed_limit, xseg.speed_limit::INT AS current_speed_limit, {VERSION} FROM dseg LEFT JOIN xseg USING (segment_code)"""),
    "sensor": ("sensor", "sensor_key", "serial_number", f"""SELECT dsen.serial_number, sensor_type_name, technology, segment_code, CASE WHEN NOT is_inferred THEN 'OK' END AS status_class, CASE WHEN NOT is_inferred THEN DATE '1994-01-01' END AS install_date, {VERSION} FROM dsen LEFT JOIN xsen USING (serial_number)"""),
    "vehicle_type": ("vehicle_type", "vehicle_type_key", "type_code", "SELECT type_code, type_code[1] || lower(type_code[2:]) AS type_name, 'Any' AS category, (type_code IN ('PURCHASE', 'SIGNUP'))::INT AS is_heavy FROM xveh"),
    "incident_type": ("incident_type", "incident_type_key", "type_code", "SELECT type_code, type_name, category, 2 AS default_severity FROM xtype"),
    "emergency_unit": ("unit", "unit_key", "unit_code", "SELECT unit_code, 'Police' AS unit_type, 'HQ' AS home_station, vehicle_make, vehicle_model FROM xunit"),
    "traffic_light": ("light", "light_key", "controller_code", "SELECT controller_code, intersection_name, current_timing_plan, NULL::VARCHAR AS previous_timing_plan, NULL::DATE AS timing_plan_changed, cycle_seconds::INT AS cycle_seconds, 'OK' AS status FROM xlight"),
    "traffic_camera": ("camera", "camera_key", "camera_code", "SELECT camera_code, intersection_name, 'M' AS model, '4k' AS resolution, '2' AS firmware_version, 'OK' AS status FROM xcam"),
}
#: Columns of the unknown member that are no texts.
NOT_TEXT = {"latitude", "longitude", "length_m", "lane_count", "speed_limit", "current_speed_limit", "install_date", "is_heavy", "default_severity", "timing_plan_changed", "cycle_seconds"}
VERSIONED_AS = {"is_current": "true", "version_number": "1", "is_inferred": "false"}


def view_sql(view: str) -> str:
    """All columns of a view: its members, numbered, and the unknown one."""
    _, key, code, members = SHOWN[view]
    columns = [c for c in semantic.PROJECTIONS[view] if c != key]
    order = f"is_inferred, {code}" if "is_inferred" in columns else code
    unknown = ", ".join("NULL" if c in NOT_TEXT else VERSIONED_AS.get(c, "'Unknown'") for c in columns)
    names = ", ".join(columns)
    return f", {NIGHT}, members AS ({members}) SELECT row_number() OVER (ORDER BY {order})::INT AS {key}, {names} FROM members UNION ALL SELECT -1, {unknown}"


for _k, (_view, (_dim, *_)) in enumerate(SHOWN.items(), 4):
    bind(f"b{_k if _k < 6 else _k + 1}_{_view}", view_sql(_view))(
        lambda s, d, v=_view, t=_dim: (lambda x: x.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude") if c in x.columns}))(semantic.bi_view(v, samples.run_warehouse(s, d)["tables"][t]))
    )
bind("b6_weather", f", {FEED} SELECT condition_code, count(*) AS n FROM (SELECT unnest(['DRY', 'RAIN', 'SNOW', 'FOG', 'ICE', 'STORM']) AS condition_code, unnest(range(6)) AS z) c, range(61) r GROUP BY 1 UNION ALL SELECT 'UNK', 1")(
    lambda s, d: semantic.bi_view("weather", samples.seed_warehouse(s, d)["dims"]["weather"]).groupBy("condition_code").agg(F.count("*").alias("n"))
)
bind("b1_date", "WITH x AS (SELECT date_key, full_date FROM date) SELECT date_key, full_date, 'Q' || quarter(full_date) AS quarter FROM x")(
    lambda s, d: semantic.bi_date(samples.seed_warehouse(s, d)["dims"]["date"]).join(T.dates(s, d).select("date_key"), "date_key").select("date_key", "full_date", "quarter")
)
bind("b2_hour", "SELECT DISTINCT hour_of_day, lpad(hour_of_day::VARCHAR, 2, '0') || ':00' AS hour_label, (hour_of_day IN (7, 8, 16, 17, 18))::INT AS is_rush_hour FROM det")(
    lambda s, d: semantic.bi_hour(samples.seed_warehouse(s, d)["dims"]["time"]).join(T.detections(s, d).select("hour_of_day").distinct(), "hour_of_day").select("hour_of_day", "hour_label", "is_rush_hour")
)
bind("b3_time_of_day", "SELECT DISTINCT time_key, lpad((time_key // 60)::VARCHAR, 2, '0') || ':' || lpad((time_key % 60)::VARCHAR, 2, '0') AS time FROM det")(
    lambda s, d: semantic.bi_time_of_day(samples.seed_warehouse(s, d)["dims"]["time"]).join(T.detections(s, d).select("time_key").distinct(), "time_key").select("time_key", "time")
)
bind("g6_weather_members", "WITH c AS (SELECT DISTINCT condition_code FROM fht) SELECT condition_code, 61::BIGINT AS n, (CASE WHEN condition_code IN ('SNOW', 'FOG', 'ICE', 'STORM') THEN 61 ELSE 30 END)::BIGINT AS severe FROM c")(
    lambda s, d: spines.build_dim_weather(s).groupBy("condition_code").agg(F.count("*").alias("n"), F.sum("is_severe").alias("severe")).join(T.hourly(s, d).select("condition_code").distinct(), "condition_code")
)
bind("b17_kpi_daily", "WITH t AS (SELECT date_key, sum(vehicle_count)::BIGINT AS total_vehicles, sum(avg_speed * vehicle_count)::DOUBLE / sum(vehicle_count)::DOUBLE AS network_avg_speed, count(DISTINCT CASE WHEN vehicle_count > 0 THEN segment_key END) AS segments_with_traffic FROM fht GROUP BY 1), i AS (SELECT detected_date_key + 260000 AS date_key, count(*) AS incidents, trunc(sum(minutes_to_clear)::DOUBLE / count(minutes_to_clear))::INT AS avg_clearance_min, quantile_cont(minutes_to_arrive, 0.5)::DOUBLE AS median_response_min FROM fil GROUP BY 1), r AS (SELECT date_key, count(DISTINCT sensor_key) AS reporting_sensors FROM det WHERE sensor_key <> -1 GROUP BY 1), n AS (SELECT count(DISTINCT sensor_key) AS n FROM det WHERE sensor_key <> -1) SELECT t.*, coalesce(incidents, 0) AS incidents, avg_clearance_min, median_response_min, reporting_sensors, coalesce(reporting_sensors, 0)::DOUBLE * 100 / n AS sensor_health_pct FROM t LEFT JOIN i USING (date_key) LEFT JOIN r USING (date_key), n")(
    lambda s, d: semantic.bi_kpi_daily(
        T.hourly(s, d), T.incidents(s, d).withColumn("detected_date_key", F.col("detected_date_key") + 260000), T.detections(s, d), T.detections(s, d).where("sensor_key <> -1").select("sensor_key").distinct().withColumn("is_current", F.lit(True))
    ).select("date_key", "total_vehicles", "network_avg_speed", "segments_with_traffic", "incidents", "avg_clearance_min", "median_response_min", "reporting_sensors", "sensor_health_pct")
)
bind("a17_integer_average", "SELECT unit_key, trunc(sum(minutes_to_clear)::DOUBLE / count(minutes_to_clear))::INT AS avg_clearance_min FROM fil GROUP BY 1")(lambda s, d: T.incidents(s, d).groupBy("unit_key").agg((F.sum("minutes_to_clear").cast("double") / F.count("minutes_to_clear")).cast("int").alias("avg_clearance_min")))
bind("j10_cross_members", "SELECT e.event_type, f.o_orderpriority FROM (SELECT DISTINCT event_type FROM events) e, (SELECT DISTINCT o_orderpriority FROM orders) f", False)(lambda s, d: joins.cross_members(T.table(s, d, "events").select("event_type").distinct(), T.table(s, d, "orders").select("o_orderpriority").distinct()))
bind("b18_reject_daily", f", {FEED} SELECT CASE WHEN reason = 'X' THEN -1 ELSE strftime(on_day, '%Y%m%d')::INT END AS date_key, reason AS reject_reason, count(*) AS rejected_rows FROM e WHERE reason IS NOT NULL GROUP BY ALL")(
    lambda s, d: semantic.bi_reject_daily(s.read.parquet(f"{samples.run_lake(s, d)['lake']}/silver/quarantine").where("reject_reason <> 'CORRUPT_RECORD'")).groupBy("date_key", "reject_reason").agg(F.sum("rejected_rows").alias("rejected_rows"))
)
bind("v8_boundary_rules", f", {FEED} SELECT event_id::VARCHAR AS event_id, CASE WHEN NOT named THEN 'MISSING_KEY' WHEN tenths <= 0 OR tenths > 2500 THEN 'SPEED_RANGE' WHEN NOT cam AND (occ < 0 OR occ > 100) THEN 'OCCUPANCY_RANGE' WHEN on_day <> d THEN 'DATE_MISMATCH' END AS reject_reason FROM raw")(
    lambda s, d: cleanse.apply_rules(lake.conformed_bronze(s, samples.run_lake(s, d)["lake"], samples.run_lake(s, d)["day"]), C.boundary_rules()).dropDuplicates(["event_id"]).select("event_id", "reject_reason")
)
for _n, _by, _sql in (("uptime", "sensor_key", "count(DISTINCT date_key || ':' || hour_of_day)::DOUBLE * 100 / (24 * count(DISTINCT date_key))::DOUBLE AS uptime FROM det"), ("reject_rate", "segment_code", "NULL")):
    if _n == "uptime":
        bind(f"x3_{_n}", f"SELECT {_by}, {_sql} GROUP BY 1")(lambda s, d: semantic.bi_measure("uptime", T.hourly(s, d), T.incidents(s, d), T.detections(s, d), T.detections(s, d), ("sensor_key",)))
    else:
        bind(f"x3_{_n}", "SELECT segment_code, count(*) FILTER (event_id % 5 = 0)::DOUBLE * 100 / (count(*) FILTER (event_id % 5 = 0) + count(*) FILTER (event_id % 5 <> 0))::DOUBLE AS reject_rate FROM det GROUP BY 1")(
            lambda s, d: semantic.bi_measure("reject_rate", T.hourly(s, d), T.incidents(s, d), T.detections(s, d).where("event_id % 5 <> 0"), T.detections(s, d).where("event_id % 5 = 0"), ("segment_code",))
        )

# ---------------------------------------------------------------- branches of versioned dimensions


def second_load(s: SparkSession, d: str, same_day: bool) -> DataFrame:
    """Customers: a third of the first day's are inferred, or all are loaded on the day of the second load; then the source comes with changes."""
    first, source = customer_dim(s, d)
    dim = first.withColumn("effective_date", F.lit("1998-01-01").cast("date")) if same_day else first.withColumn("is_inferred", F.col("c_custkey") % 3 == 0)
    out = dimensions.scd2_merge(dim, source, "c_custkey", "customer_key", ("segment", "nation"), "1998-01-01", type0={"original_segment": "segment"}, type6={"current_segment": "segment"})
    return out.select("c_custkey", "segment", "version_number", "is_inferred", "is_current")


CHANGED = "c AS (SELECT c_custkey, c_mktsegment AS old, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS new FROM customer)"
bind("c2b_inferred_completion", f"WITH {CHANGED} SELECT c_custkey, new AS segment, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 AND old <> new THEN 2 ELSE 1 END AS version_number, false AS is_inferred, true AS is_current FROM c UNION ALL SELECT c_custkey, old, 1, false, false FROM c WHERE c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 AND old <> new", False)(lambda s, d: second_load(s, d, False))
bind("c2c_same_day_correction", f"WITH {CHANGED} SELECT c_custkey, new AS segment, 1 AS version_number, false AS is_inferred, true AS is_current FROM c", False)(lambda s, d: second_load(s, d, True))
bind("c5_type1_on_type2", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 11 <> 0 AND c_mktsegment <> 'CHANGED' THEN 2 ELSE 1 END AS version_number, round(c_acctbal * 100)::BIGINT AS cents, true AS is_current FROM customer UNION ALL SELECT c_custkey, 1, 0, false FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 11 <> 0", False)(
    lambda s, d: (lambda dim, source: dimensions.scd2_merge(
        dim.select("customer_key", "c_custkey", "segment", F.lit(0).cast("long").alias("cents"), *dimensions.VERSION_COLUMNS), source.join(T.table(s, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents")), "c_custkey"),
        "c_custkey", "customer_key", ("segment", "nation"), "1998-01-01", type1=("cents",),
    ))(*customer_dim(s, d)).select("c_custkey", "version_number", "cents", "is_current")
)
bind("c4_type6", "SELECT c_custkey, current_segment, count(*) AS versions FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS current_segment, unnest(CASE WHEN c_custkey % 10 = 0 AND c_custkey % 11 <> 0 AND c_mktsegment <> 'CHANGED' THEN [1, 2] ELSE [1] END) AS v FROM customer) GROUP BY ALL", False)(
    lambda s, d: (lambda dim, source: dimensions.scd2_merge(dim, source, "c_custkey", "customer_key", ("segment", "nation"), "1998-01-01", type0={"original_segment": "segment"}, type6={"current_segment": "segment"}))(*customer_dim(s, d)).groupBy("c_custkey", "current_segment").agg(F.count("*").alias("versions"))
)
bind("c10_types_4_and_5", "WITH m AS (SELECT c_mktsegment, c_nationkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey)::INT AS mini_key FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)) SELECT c_custkey, mini_key FROM customer JOIN m USING (c_mktsegment, c_nationkey)", False)(
    lambda s, d: (lambda c: dimensions.outrigger(c, dimensions.mini_dimension(c, ("c_mktsegment", "c_nationkey"), "mini_key"), ("c_mktsegment", "c_nationkey"), "mini_key").select("c_custkey", "mini_key"))(T.table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"))
)

# ---------------------------------------------------------------- the forty checks

bind("q_catalogue", f", {NIGHT}, x AS (SELECT unnest([{', '.join(repr(c[0]) for c in audit.catalogue())}]) AS check_name) SELECT check_name, CASE check_name WHEN 'UNKNOWN_RATE_FTE' THEN unknown WHEN 'SPEED_VS_LIMIT_FHT' THEN fast ELSE 0 END::BIGINT AS failed_rows FROM x, warned")(
    night("quality_log", "check_name", "failed_rows")
)
N = "try_cast(substring(incident_number, 2) as long)"


def defects(s: SparkSession, d: str) -> audit.Context:
    """The night's warehouse with every check's defect planted in it."""
    made = samples.run_warehouse(s, d)
    t, day_key = dict(made["tables"]), int(made["day"].replace("-", ""))
    e, h, n, bad = F.col("event_id").cast("long"), F.col("hour_of_day"), F.expr(N), F.lit(99999)
    put = lambda df, **new: df.withColumns({k: F.when(when, F.lit(v) if not hasattr(v, "cast") else v).otherwise(F.col(k)).cast(df.schema[k].dataType) for k, (when, v) in new.items()})
    fte = put(t["fte"], segment_key=(e % 11 == 0, bad), sensor_key=(e % 13 == 0, bad), camera_key=(e % 17 == 0, bad), vehicle_type_key=(e % 19 == 0, bad), weather_key=(e % 23 == 0, bad), speed_kmh=(e % 31 == 0, F.lit(300)), date_key=(e % 37 == 0, F.lit(29990101)))
    t["fte"] = fte.unionByName(fte.where(e % 29 == 0))
    fht = t["fht"].withColumn("avg_speed", F.lit(10).cast("decimal(7,1)")).where(h != 8)
    phantom = fht.where(h == 9).withColumns({"date_key": F.lit(20990101), "vehicle_count": F.lit(0).cast("long"), "weather_key": F.lit(-1)})
    t["fht"] = put(fht, segment_key=(h == 3, bad), weather_key=(h == 4, bad), vehicle_count=(h == 5, F.lit(-1)), avg_speed=(h == 6, F.lit(999)), congestion_index=(h == 7, F.lit(2))).unionByName(phantom)
    t["fil"] = put(t["fil"], incident_type_key=(n % 10 == 0, bad), detected_date_key=(n % 7 == 1, F.lit(17000101)), closed_date_key=((n % 9 == 2) & F.col("closed_ts").isNotNull(), F.lit(19000101)), minutes_to_arrive=((n % 8 == 3) & F.col("arrived_ts").isNotNull(), F.lit(-5)))
    t["date"], t["time"], t["unit"] = t["date"].where(F.col("date_key") != day_key), t["time"].where("time_key = -1"), t["unit"].where("unit_key <> -1")
    t["camera"] = t["camera"].unionByName(t["camera"].where("camera_key <> -1").withColumn("camera_key", F.col("camera_key") + 100000))
    t["light"] = t["light"].unionByName(t["light"].where("light_key <> -1").withColumns({"light_key": F.col("light_key") + 100000, "controller_code": F.concat(F.lit("Z"), "controller_code")}))
    for dim, key, code in (("segment", "segment_key", "segment_code"), ("sensor", "sensor_key", "serial_number")):
        twice = t[dim].where(F.col(key) != -1).withColumn(key, F.col(key) + 100000)
        ghost = t[dim].where(F.col(key) == -1).withColumns({key: F.lit(200000), code: F.lit("GHOST"), "is_current": F.lit(False), "expiration_date": F.lit("1800-01-01").cast("date")})
        t[dim] = t[dim].unionByName(twice).unionByName(ghost)
    late = F.explode(F.sequence("load_date", F.date_add("load_date", 10)))
    t["batches"] = t["batches"].withColumn("load_date", late)
    t["rowlog"] = t["rowlog"].withColumn("rows_inserted", F.when(F.col("step") == "Fact.TrafficEvent", F.col("rows_inserted") - 1).otherwise(F.col("rows_inserted")))
    today = int(days_after(made["day"], 30))
    return audit.Context(t, day_key, 1, today)


def days_after(day: str, ahead: int) -> str:
    return (samples.date.fromisoformat(day) + samples.timedelta(days=ahead)).strftime("%Y%m%d")


PLANTED = f"""{NIGHT},
g AS (SELECT event_id, cam, segment_code, CASE WHEN event_id % 29 = 0 THEN 2 ELSE 1 END AS w, event_id % 37 <> 0 AS loaded FROM good),
i AS (SELECT *, substring(incident_number, 2)::BIGINT AS n FROM xinc),
c AS (SELECT (SELECT count(*) FROM dseg) AS segs, (SELECT count(*) FROM dsen) AS sens, (SELECT count(*) FROM xseg) AS known_segs, (SELECT coalesce(sum(w), 0) FROM g WHERE loaded) AS rows),
x(check_name, failed_rows) AS (
  SELECT 'ORPHAN_FTE_DATE', rows FROM c UNION ALL SELECT 'ORPHAN_FTE_TIME', rows FROM c
  UNION ALL SELECT 'ORPHAN_FTE_SEGMENT', sum(w) FROM g WHERE loaded AND event_id % 11 = 0 UNION ALL SELECT 'ORPHAN_FTE_SENSOR', sum(w) FROM g WHERE loaded AND event_id % 13 = 0 UNION ALL SELECT 'ORPHAN_FTE_CAMERA', sum(w) FROM g WHERE loaded AND event_id % 17 = 0
  UNION ALL SELECT 'ORPHAN_FTE_VEHICLETYPE', sum(w) FROM g WHERE loaded AND event_id % 19 = 0 UNION ALL SELECT 'ORPHAN_FTE_WEATHER', sum(w) FROM g WHERE loaded AND event_id % 23 = 0
  UNION ALL SELECT 'ORPHAN_FHT_DATE', 24 * segs FROM c UNION ALL SELECT 'ORPHAN_FHT_SEGMENT', segs FROM c UNION ALL SELECT 'ORPHAN_FHT_WEATHER', segs FROM c
  UNION ALL SELECT 'DETECTOR_ROUTING_FTE', sum(w) FROM g WHERE loaded AND (NOT cam AND event_id % 17 = 0 OR cam AND event_id % 13 = 0)
  UNION ALL SELECT 'ORPHAN_FIL_DIMS', count(*) FROM i WHERE n % 10 = 0 OR unit_code IS NULL OR unit_code NOT IN (SELECT unit_code FROM xunit)
  UNION ALL SELECT 'ORPHAN_FIL_MILESTONE_DATES', count(*) FROM i WHERE n % 7 = 1 OR n % 9 = 2 AND closed_ts IS NOT NULL
  UNION ALL SELECT 'DUP_BK_TYPE1_DIMS', count(*) FROM xcam UNION ALL SELECT 'DUP_CURRENT_DIMROADSEGMENT', segs FROM c UNION ALL SELECT 'DUP_CURRENT_DIMSENSOR', sens FROM c UNION ALL SELECT 'DUP_INTERSECTION_DIMTRAFFICLIGHT', count(*) FROM xlight
  UNION ALL SELECT 'DUP_FACT_TRAFFICEVENT', count(*) FROM g WHERE w = 2 UNION ALL SELECT 'SCD2_OVERLAP_DIMROADSEGMENT', segs FROM c UNION ALL SELECT 'SCD2_OVERLAP_DIMSENSOR', sens FROM c
  UNION ALL SELECT 'SCD2_NOCURRENT_DIMROADSEGMENT', 1 UNION ALL SELECT 'SCD2_NOCURRENT_DIMSENSOR', 1 UNION ALL SELECT 'SCD2_INVERTED_INTERVAL', 2
  UNION ALL SELECT 'NEGATIVE_COUNTS_FHT', segs FROM c UNION ALL SELECT 'SPEED_RANGE_FTE', sum(w) FROM g WHERE event_id % 31 = 0 UNION ALL SELECT 'SPEED_VS_LIMIT_FHT', known_segs FROM c UNION ALL SELECT 'CONGESTION_RANGE_FHT', segs FROM c
  UNION ALL SELECT 'FUTURE_DATE_FTE', sum(w) FROM g WHERE NOT loaded UNION ALL SELECT 'MILESTONE_ORDER_FIL', count(*) FROM i WHERE n % 9 = 2 AND closed_ts IS NOT NULL UNION ALL SELECT 'NEGATIVE_LAGS_FIL', count(*) FROM i WHERE n % 8 = 3 AND arrived_ts IS NOT NULL
  UNION ALL SELECT 'UNKNOWN_MEMBER_MISSING', 1 UNION ALL SELECT 'MANDATORY_DIMS_POPULATED', 1 UNION ALL SELECT 'SNAPSHOT_DENSITY_FHT', 48 * segs - 23 * segs FROM c UNION ALL SELECT 'PHANTOM_DAY_FHT', 1
  UNION ALL SELECT 'UNKNOWN_RATE_FTE', sum(w) FROM g WHERE loaded AND segment_code IS NULL AND event_id % 11 <> 0 UNION ALL SELECT 'MISSING_LOAD_DATE', 10
  UNION ALL SELECT 'INFERRED_NEVER_COMPLETED', 2 * ((SELECT count(*) FROM dseg WHERE is_inferred) + (SELECT count(*) FROM dsen WHERE is_inferred)) UNION ALL SELECT 'RECON_ROWLOG_BATCH', 1
  UNION ALL SELECT 'RECON_STG_FACT_EVENTS', abs((SELECT count(*) FROM g) - rows) FROM c UNION ALL SELECT 'RECON_STG_FACT_HOURLY', count(*) FROM hr WHERE h IN (3, 8))"""
bind("q_catalogue_planted", f", {PLANTED} SELECT check_name, coalesce(failed_rows, 0)::BIGINT AS failed_rows FROM x")(
    lambda s, d: audit.run_checks(s, audit.catalogue(), defects(s, d)).select("check_name", "failed_rows")
)
