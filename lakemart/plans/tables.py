"""The star that the driver's tables stand for, in DataFrames and, as PRELUDE, in SQL.

Events are detections: 50 segments, the event's type as the vehicle's class, the value as speed. Orders are incidents,
whose milestones follow from the order's number and status. Customers are members of a versioned dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import analytics as A
from lakemart.operators import facts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, seg = F.col("ts"), F.col("user_id") % 50
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("event_ts"), F.to_date(ts).alias("event_date"), C.date_key(ts).alias("date_key"), C.time_key(ts).alias("time_key"), F.hour(ts).alias("hour_of_day"),
        seg.alias("segment_key"), F.concat(F.lit("S"), seg.cast("string")).alias("segment_code"), "user_id", "event_type", F.length("event_type").alias("vehicle_type_key"),
        F.col("value").cast("decimal(7,2)").alias("speed_kmh"), F.get_json_object("props", "$.k").cast("int").alias("occupancy_pct"),
        F.when(F.col("event_id") % 3 == 0, "CAMERA").otherwise("SENSOR").alias("detector_type"), (F.col("event_id") % 7).alias("weather_key"),
        F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")).alias("sensor_key"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).otherwise(F.lit(-1).cast("long")).alias("camera_key"),
        (F.lit(30) + seg % 4 * 10).cast("int").alias("speed_limit"), (F.col("event_id") % 600).cast("decimal(6,2)").alias("headway_seconds"),
    ).withColumn("speed_over_limit_kmh", C.over_limit(F.col("speed_kmh"), F.col("speed_limit")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("segment_key")
    text = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("segment_key")).distinct().select(
        "segment_key", F.concat(F.lit("S"), k.cast("string")).alias("segment_code"), text("R", 10).alias("road_code"), text("Road ", 10).alias("road_name"), text("C", 10).alias("road_category"),
        text("City ", 2).alias("city"), text("D", 5).alias("district"), text("X", 8).alias("end_intersection"), (F.lit(30) + k % 4 * 10).cast("int").alias("speed_limit"),
        (F.lit(200) + k * 10).alias("length_m"), F.lit(True).alias("is_current"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    by = ("date_key", "event_date", "hour_of_day", "segment_key", "segment_code", "speed_limit")
    made = A.hourly(d, by, F.col("event_type").isin("purchase", "signup"), "speed_kmh", "occupancy_pct", F.count_if(F.col("event_type") == "error").alias("incident_count"), F.max("weather_key").alias("weather_key"))
    return made.withColumns({"avg_speed": F.col("avg_speed").cast("decimal(7,1)"), "p85_speed": F.col("p85_speed").cast("decimal(7,1)")}).withColumns({
        "congestion_index": C.congestion_index(F.col("avg_speed"), F.col("speed_limit")),
        "condition_code": F.element_at(F.array(*[F.lit(c) for c in C.CONDITIONS]), (F.col("hour_of_day") % 6 + 1)),
        "avg_temp_c": (F.col("hour_of_day") - 8).cast("double"), "precipitation_mm": (F.col("hour_of_day") % 5 * 2).cast("double"), "visibility_m": (F.col("hour_of_day") * 150).cast("int"),
    })


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("full_date")
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("full_date")).distinct().select(
        C.date_key(d).alias("date_key"), "full_date", F.year(d).alias("year"), F.month(d).alias("month_number"), F.date_format(d, "yyyy-MM").alias("year_month"), (F.weekday(d) + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) > 4).cast("int").alias("is_weekend"), (F.dayofmonth(d) == 1).cast("int").alias("is_holiday"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("weather_key")
    return table(spark, sf_dir, "events").select((F.col("event_id") % 7).alias("weather_key")).distinct().select(
        "weather_key", F.concat(F.lit("W"), (k % 3).cast("string")).alias("condition_name"), F.when(k > 4, "Heavy").otherwise("None").alias("precip_band"), (k > 4).cast("int").alias("is_severe")
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by the length of their names: error and click share one key's category, so the first name stands for both."""
    t = table(spark, sf_dir, "events").groupBy(F.length("event_type").alias("vehicle_type_key")).agg(F.min("event_type").alias("type_name"))
    return t.withColumns({"category": F.when(F.col("vehicle_type_key") > 5, "Heavy").otherwise("Light"), "is_heavy": (F.col("vehicle_type_key") > 5).cast("int")})


def incident_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    after = lambda t, s: F.timestamp_seconds(F.unix_timestamp(t) + s)
    o = table(spark, sf_dir, "orders").withColumn("detected_ts", after(day, k % 1440 * 60 + k % 59))
    o = o.withColumn("dispatched_ts", F.when(F.col("o_orderstatus") != "O", after("detected_ts", (k % 6 + 2) * 60 + k % 60)))
    o = o.withColumn("arrived_ts", after("dispatched_ts", (k % 13 + 4) * 60))
    o = o.withColumn("cleared_ts", F.when(F.col("o_orderstatus") == "F", after("arrived_ts", (k % 50 + 10) * 60 + k % 47)))
    o = o.withColumn("closed_ts", after("cleared_ts", (k % 20 + 5) * 60))
    return o.select(
        k.alias("incident_number"), "detected_ts", "dispatched_ts", "arrived_ts", "cleared_ts", "closed_ts", F.substring("o_orderpriority", 1, 1).cast("int").alias("incident_type_key"), (F.col("o_custkey") % 50).alias("segment_key"),
        (k % 7).alias("unit_key"), (k % 7).alias("weather_key"), F.col("o_orderstatus").alias("current_status"), (k % 4 + 1).alias("severity"), (k % 3).alias("lanes_blocked"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.lifecycle(incident_source(spark, sf_dir))


def incident_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kinds = table(spark, sf_dir, "orders").select(p).distinct()
    return kinds.select(F.substring(p, 1, 1).cast("int").alias("incident_type_key"), p.alias("type_name"), F.when(F.substring(p, 1, 1) <= "2", "Accident").otherwise("Other").alias("category"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("unit_key")).distinct().withColumn("unit_type", F.when(F.col("unit_key") < 3, "Police").otherwise("Medical"))


def incident_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(d.alias("full_date")).distinct().select(C.date_key(F.col("full_date")).alias("date_key"), "full_date", F.year("full_date").alias("year"), F.date_format("full_date", "yyyy-MM").alias("year_month"))


def lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select(F.col("end_intersection").alias("intersection_name")).distinct().select(
        F.concat(F.lit("L"), F.substring("intersection_name", 2, 9)).alias("controller_code"), "intersection_name", F.lit("B").alias("current_timing_plan"), F.lit("A").alias("previous_timing_plan"), F.lit("2024-01-15").cast("date").alias("timing_plan_changed"),
        (F.lit(60) + F.substring("intersection_name", 2, 9).cast("int") * 5).alias("cycle_seconds"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order, customer, nation and region: the subject of grouping sets and top-n."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(
        F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("market"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        "l_returnflag", F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
    )


PRELUDE = """
WITH det AS (
  SELECT event_id, ts AS event_ts, ts::DATE AS event_date, year(ts) * 10000 + month(ts) * 100 + day(ts) AS date_key, hour(ts) * 60 + minute(ts) AS time_key, hour(ts) AS hour_of_day,
    user_id % 50 AS segment_key, 'S' || (user_id % 50) AS segment_code, user_id, event_type, length(event_type) AS vehicle_type_key, value::DECIMAL(7,2) AS speed_kmh,
    json_extract_string(props, '$.k')::INT AS occupancy_pct, CASE WHEN event_id % 3 = 0 THEN 'CAMERA' ELSE 'SENSOR' END AS detector_type, event_id % 7 AS weather_key,
    CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS sensor_key, CASE WHEN event_id % 3 = 0 THEN user_id ELSE -1 END AS camera_key,
    30 + user_id % 50 % 4 * 10 AS speed_limit, (event_id % 600)::DECIMAL(6,2) AS headway_seconds, value::DECIMAL(7,2) - (30 + user_id % 50 % 4 * 10) AS speed_over_limit_kmh
  FROM events),
seg AS (
  SELECT DISTINCT segment_key, segment_code, 'R' || segment_key % 10 AS road_code, 'Road ' || segment_key % 10 AS road_name, 'C' || segment_key % 10 AS road_category, 'City ' || segment_key % 2 AS city,
    'D' || segment_key % 5 AS district, 'X' || segment_key % 8 AS end_intersection, speed_limit, 200 + segment_key * 10 AS length_m, true AS is_current FROM det),
h0 AS (
  SELECT date_key, event_date, hour_of_day, segment_key, segment_code, speed_limit, sum(occupancy_pct)::BIGINT AS occ, count(*) AS vehicle_count, count(*) FILTER (event_type IN ('purchase', 'signup')) AS heavy_vehicle_count,
    sum((speed_kmh * 100)::BIGINT) AS cents, (quantile_disc(speed_kmh, 0.85) * 100)::BIGINT AS p85_cents, count(*) FILTER (event_type = 'error') AS incident_count, max(weather_key) AS weather_key
  FROM det GROUP BY ALL),
h1 AS (SELECT *, (2 * cents + 10 * vehicle_count) // (20 * vehicle_count) AS tenths, (p85_cents + 5) // 10 AS p85_tenths, ((200 * occ + vehicle_count) // (2 * vehicle_count))::DOUBLE / 100 AS avg_occupancy FROM h0),
fht AS (
  SELECT *, (tenths / 10.0)::DECIMAL(7,1) AS avg_speed, (p85_tenths / 10.0)::DECIMAL(7,1) AS p85_speed,
    (greatest(0, least(1000, (2000 * (10 * speed_limit - tenths) + 10 * speed_limit) // (20 * speed_limit))) / 1000.0)::DECIMAL(4,3) AS congestion_index,
    (['DRY', 'RAIN', 'FOG', 'SNOW', 'ICE', 'STORM'])[hour_of_day % 6 + 1] AS condition_code, (hour_of_day - 8)::DOUBLE AS avg_temp_c, (hour_of_day % 5 * 2)::DOUBLE AS precipitation_mm, (hour_of_day * 150)::INT AS visibility_m
  FROM h1),
date AS (
  SELECT DISTINCT date_key, event_date AS full_date, year(event_date) AS year, month(event_date) AS month_number, strftime(event_date, '%Y-%m') AS year_month, isodow(event_date) AS day_of_week,
    dayname(event_date) AS day_name, (isodow(event_date) > 5)::INT AS is_weekend, (day(event_date) = 1)::INT AS is_holiday FROM det),
weather AS (SELECT DISTINCT weather_key, 'W' || weather_key % 3 AS condition_name, CASE WHEN weather_key > 4 THEN 'Heavy' ELSE 'None' END AS precip_band, (weather_key > 4)::INT AS is_severe FROM det),
vehicle AS (SELECT vehicle_type_key, min(event_type) AS type_name, CASE WHEN vehicle_type_key > 5 THEN 'Heavy' ELSE 'Light' END AS category, (vehicle_type_key > 5)::INT AS is_heavy FROM det GROUP BY ALL),
i1 AS (SELECT *, o_orderdate + to_seconds(o_orderkey % 1440 * 60 + o_orderkey % 59) AS detected_ts FROM orders),
i2 AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN detected_ts + to_seconds((o_orderkey % 6 + 2) * 60 + o_orderkey % 60) END AS dispatched_ts FROM i1),
i3 AS (SELECT *, dispatched_ts + to_seconds((o_orderkey % 13 + 4) * 60) AS arrived_ts FROM i2),
i4 AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN arrived_ts + to_seconds((o_orderkey % 50 + 10) * 60 + o_orderkey % 47) END AS cleared_ts FROM i3),
i5 AS (SELECT *, cleared_ts + to_seconds((o_orderkey % 20 + 5) * 60) AS closed_ts FROM i4),
fil AS (
  SELECT o_orderkey AS incident_number, detected_ts, dispatched_ts, arrived_ts, cleared_ts, closed_ts, o_orderpriority[1]::INT AS incident_type_key, o_custkey % 50 AS segment_key, o_orderkey % 7 AS unit_key, o_orderkey % 7 AS weather_key,
    o_orderstatus AS current_status, o_orderkey % 4 + 1 AS severity, o_orderkey % 3 AS lanes_blocked,
    coalesce(strftime(detected_ts, '%Y%m%d')::INT, -1) AS detected_date_key, coalesce(hour(detected_ts) * 60 + minute(detected_ts), -1) AS detected_time_key,
    coalesce(strftime(dispatched_ts, '%Y%m%d')::INT, -1) AS dispatched_date_key, coalesce(hour(dispatched_ts) * 60 + minute(dispatched_ts), -1) AS dispatched_time_key,
    coalesce(strftime(arrived_ts, '%Y%m%d')::INT, -1) AS arrived_date_key, coalesce(hour(arrived_ts) * 60 + minute(arrived_ts), -1) AS arrived_time_key,
    coalesce(strftime(cleared_ts, '%Y%m%d')::INT, -1) AS cleared_date_key, coalesce(hour(cleared_ts) * 60 + minute(cleared_ts), -1) AS cleared_time_key,
    coalesce(strftime(closed_ts, '%Y%m%d')::INT, -1) AS closed_date_key, coalesce(hour(closed_ts) * 60 + minute(closed_ts), -1) AS closed_time_key,
    datediff('minute', detected_ts, dispatched_ts)::INT AS minutes_to_dispatch, datediff('minute', dispatched_ts, arrived_ts)::INT AS minutes_to_arrive,
    datediff('minute', arrived_ts, cleared_ts)::INT AS minutes_to_clear, datediff('minute', detected_ts, closed_ts)::INT AS total_duration_minutes
  FROM i5),
kind AS (SELECT DISTINCT o_orderpriority[1]::INT AS incident_type_key, o_orderpriority AS type_name, CASE WHEN o_orderpriority[1] <= '2' THEN 'Accident' ELSE 'Other' END AS category FROM orders),
unit AS (SELECT DISTINCT o_orderkey % 7 AS unit_key, CASE WHEN o_orderkey % 7 < 3 THEN 'Police' ELSE 'Medical' END AS unit_type FROM orders),
idate AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d')::INT AS date_key, o_orderdate::DATE AS full_date, year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders),
light AS (SELECT DISTINCT 'L' || end_intersection[2:] AS controller_code, end_intersection AS intersection_name, 'B' AS current_timing_plan, 'A' AS previous_timing_plan, DATE '2024-01-15' AS timing_plan_changed, 60 + end_intersection[2:]::INT * 5 AS cycle_seconds FROM seg),
sales AS (
  SELECT r_name AS region, n_name AS nation, c_mktsegment AS market, year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS month, l_returnflag, l_quantity::BIGINT AS quantity, l_extendedprice::DECIMAL(12,2) AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
