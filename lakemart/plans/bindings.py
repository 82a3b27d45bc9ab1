"""The registered queries: each operator bound to the driver's tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import analytics as A
from lakemart.operators import cleanse, dimensions, facts, joins, spines
from lakemart.plans import audit, kpis, marts, semantic
from lakemart.plans import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bind(name: str, sql: str | None = None, prelude: bool = True):
    """Register a function of (spark, sf_dir) under a name, with its SQL; the prelude's tables can be used there."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            more, known = sql.strip(), T.PRELUDE.rstrip()
            if more.startswith("WITH RECURSIVE"):
                more, known = "WITH" + more[len("WITH RECURSIVE") :], known.replace("WITH", "WITH RECURSIVE", 1)
            ORACLES[name] = (known + ("," + more[4:] if more.startswith("WITH") else more if more.startswith(",") else "\n" + more)) if prelude else sql.strip()
        return f

    return add


def using(f: Callable[..., DataFrame], *parts: Callable[[SparkSession, str], DataFrame], **options: object):
    """A query that applies f to bound tables; an option that is a function is called when there is a session."""
    return lambda spark, d: f(*[p(spark, d) for p in parts], **{k: v() if callable(v) else v for k, v in options.items()})


# ---------------------------------------------------------------- aggregates and marts

W = lambda m, n: f"sum({m} * vehicle_count)::DOUBLE / nullif(sum(vehicle_count), 0)::DOUBLE AS {n}"
SPEED, JAM, TOTAL = W("avg_speed", "avg_speed"), W("congestion_index", "avg_congestion"), "sum(vehicle_count)::BIGINT AS total_vehicles"
INC, HEAVY = "sum(incident_count)::BIGINT AS incidents", "sum(heavy_vehicle_count)::BIGINT AS heavy_vehicles"


def p85_of_hours(det: DataFrame) -> DataFrame:
    """A day's 85th percentile of speed from the sketches of its hours and segments."""
    hours = det.groupBy("date_key", "hour_of_day", "segment_key").agg(A.sketched("speed_kmh").alias("speeds"))
    return A.quantile_of_sketches(hours, ("date_key",), "speeds", {"p85": 0.85})


def merged_hours(det: DataFrame) -> DataFrame:
    """Hours of each day and segment with any detection, and with fast ones, from the masks of two loads."""
    hour, by = F.floor(F.col("time_key") / 60), ("date_key", "segment_key")
    load = lambda rows: rows.groupBy(*by).agg(A.hours_seen(hour, F.col("speed_kmh") > 50).alias("fast"), A.hours_seen(hour).alias("seen"))
    both = load(det.where("event_id % 2 = 0")).unionByName(load(det.where("event_id % 2 = 1")))
    return both.groupBy(*by).agg(A.hours_in(A.all_hours("fast")).alias("fast_hours"), A.hours_in(A.all_hours("seen")).alias("active_hours"))


bind("a2_hourly_traffic", "SELECT date_key, hour_of_day, segment_code, vehicle_count, heavy_vehicle_count, avg_speed, p85_speed, congestion_index, incident_count FROM fht")(
    lambda s, d: T.hourly(s, d).select("date_key", "hour_of_day", "segment_code", "vehicle_count", "heavy_vehicle_count", "avg_speed", "p85_speed", "congestion_index", "incident_count")
)
bind("a4_percentiles", "SELECT incident_type_key, quantile_cont(minutes_to_arrive, 0.5)::DOUBLE AS p50, quantile_cont(minutes_to_arrive, 0.9)::DOUBLE AS p90 FROM fil WHERE minutes_to_arrive IS NOT NULL GROUP BY ALL")(
    using(A.percentiles, T.incidents, by=("incident_type_key",), column="minutes_to_arrive", named={"p50": 0.5, "p90": 0.9})
)
bind("a6_peak_hour", "SELECT segment_code, arg_max(hour_of_day, vehicle_count * 100 - hour_of_day) AS peak_hour, max(vehicle_count) AS peak FROM fht GROUP BY ALL")(
    lambda s, d: T.hourly(s, d).groupBy("segment_code").agg(A.peak("vehicle_count", "hour_of_day").alias("peak_hour"), F.max("vehicle_count").alias("peak"))
)
bind("a7_weighted_avg", f"SELECT segment_code, {TOTAL}, {SPEED}, {JAM} FROM fht GROUP BY ALL")(
    using(A.weighted_avg, T.hourly, by=("segment_code",), measures=marts.SPEED | marts.CONGESTION, weight="vehicle_count", total="total_vehicles")
)
bind("a8_conditional_share", "SELECT segment_code, count(*) FILTER (speed_over_limit_kmh > 10) AS speeding, count(*) FILTER (speed_over_limit_kmh > 10)::DOUBLE * 100 / count(*)::DOUBLE AS pct FROM det GROUP BY ALL")(
    lambda s, d: T.detections(s, d).groupBy("segment_code").agg(F.count_if(F.col("speed_over_limit_kmh") > 10).alias("speeding"), A.share(F.col("speed_over_limit_kmh") > 10).alias("pct"))
)
bind("a3_sketched_p85", "SELECT date_key, count(speed_kmh) AS n_values, true AS within FROM det WHERE speed_kmh IS NOT NULL GROUP BY ALL")(
    lambda s, d: A.sketch_holds(T.detections(s, d), ("date_key",), "speed_kmh", p85_of_hours(T.detections(s, d)), "p85", 0.85)
)
bind("a9_active_hours_merged", "SELECT date_key, segment_key, count(DISTINCT CASE WHEN speed_kmh > 50 THEN time_key // 60 END) AS fast_hours, count(DISTINCT time_key // 60) AS active_hours FROM det GROUP BY ALL")(lambda s, d: merged_hours(T.detections(s, d)))
bind("a9_distinct_where", "SELECT date_key, count(DISTINCT CASE WHEN speed_kmh > 50 THEN segment_key END) AS n FROM det GROUP BY ALL")(
    lambda s, d: T.detections(s, d).groupBy("date_key").agg(A.distinct_where(F.col("segment_key"), F.col("speed_kmh") > 50).alias("n"))
)
bind("a10_having", "SELECT segment_code, sum(vehicle_count)::BIGINT AS n FROM fht GROUP BY ALL HAVING sum(vehicle_count) > 200")(
    lambda s, d: T.hourly(s, d).groupBy("segment_code").agg(F.sum("vehicle_count").alias("n")).where("n > 200")
)
bind("a13_rollup", "SELECT CASE WHEN grouping(region) = 1 THEN 'ALL REGIONS' ELSE region END AS region, CASE WHEN grouping(year) = 1 THEN 'ALL YEARS' ELSE year::VARCHAR END AS year, sum(quantity)::BIGINT AS quantity, sum(price)::DECIMAL(22,2) AS price FROM sales GROUP BY ROLLUP (region, year)")(
    using(lambda t: A.rollup_report(t, {"region": "ALL REGIONS", "year": "ALL YEARS"}, F.sum("quantity").alias("quantity"), F.sum("price").alias("price")), T.sales)
)
bind("a14_cube", "SELECT CASE WHEN grouping(market) = 1 THEN 'ALL' ELSE market END AS market, CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag, count(*) AS n, sum(price)::DECIMAL(22,2) AS price FROM sales GROUP BY CUBE (market, l_returnflag)")(
    using(lambda t: A.cube_report(t, {"market": "ALL", "l_returnflag": "ALL"}, F.count("*").alias("n"), F.sum("price").alias("price")), T.sales)
)
bind("a15_grouping_sets", "SELECT grouping_id(region, market, l_returnflag)::INT AS grouping_id, CASE grouping_id(region, market, l_returnflag) WHEN 3 THEN 'By region' WHEN 6 THEN 'By flag' WHEN 1 THEN 'Region x market' END AS level, region, market, l_returnflag, sum(quantity)::BIGINT AS quantity FROM sales GROUP BY GROUPING SETS ((region), (l_returnflag), (region, market))")(
    using(lambda t: A.grouping_sets_report(t, (("region",), ("l_returnflag",), ("region", "market")), ("region", "market", "l_returnflag"), {3: "By region", 6: "By flag", 1: "Region x market"}, F.sum("quantity").alias("quantity")), T.sales)
)
bind("a16_listed", "SELECT segment_code, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types FROM det GROUP BY ALL")(
    lambda s, d: T.detections(s, d).groupBy("segment_code").agg(A.listed("event_type").alias("types"))
)
bind("m0a_dim_road", "SELECT DISTINCT road_code, road_name, road_category, city FROM seg WHERE is_current AND segment_key <> -1")(using(marts.mart_dim_road, T.segments))
bind("m0b_dim_location", "SELECT DISTINCT city, district FROM seg WHERE is_current AND segment_key <> -1")(using(marts.mart_dim_location, T.segments))
bind("m1_top_busiest_roads", f"WITH x AS (SELECT road_name, road_category, {TOTAL}, {SPEED}, {JAM} FROM fht JOIN seg USING (segment_key) GROUP BY ALL) SELECT * FROM x QUALIFY rank() OVER (ORDER BY total_vehicles DESC) <= 5")(
    using(marts.mart_top_busiest_roads, T.hourly, T.segments, n=5)
)
bind("m2_avg_speed_by_road", f"SELECT road_name, {W('avg_speed', 'weighted_speed')}, {W('p85_speed', 'weighted_p85')}, max(seg.speed_limit) AS max_speed_limit FROM fht JOIN seg USING (segment_key) WHERE avg_speed IS NOT NULL GROUP BY ALL")(
    lambda s, d: marts.mart_avg_speed_by_road(T.hourly(s, d).drop("speed_limit"), T.segments(s, d))
)
bind("m3_monthly", f"SELECT year, month_number, year_month, {TOTAL}, {JAM}, {HEAVY}, {INC} FROM fht JOIN date USING (date_key) GROUP BY ALL")(using(marts.mart_monthly, T.hourly, T.dates))
bind("m4_daily", f"SELECT full_date, day_name, is_weekend, is_holiday, {TOTAL}, {SPEED}, {JAM} FROM fht JOIN date USING (date_key) GROUP BY ALL")(using(marts.mart_daily, T.hourly, T.dates))
bind("m5_rush_hour", f"SELECT hour_of_day, is_weekend, {TOTAL}, {SPEED}, {JAM} FROM fht JOIN date USING (date_key) GROUP BY ALL")(using(marts.mart_rush_hour, T.hourly, T.dates))
mean = lambda c, n: f"sum({c})::DOUBLE / nullif(count({c}), 0)::DOUBLE AS {n}"
bind("m6_accident_hotspots", f"SELECT road_name, segment_code, district, count(*) AS accidents, {mean('severity', 'avg_severity')}, sum(lanes_blocked)::BIGINT AS total_lanes_blocked, {mean('minutes_to_clear', 'avg_clearance_min')} FROM fil JOIN seg USING (segment_key) JOIN kind USING (incident_type_key) WHERE category = 'Accident' GROUP BY ALL")(
    using(marts.mart_accident_hotspots, T.incidents, T.segments, T.incident_kinds)
)
bind("m7_vehicle_stats", f"SELECT category, type_name, count(*) AS detections, {mean('speed_kmh', 'avg_speed')}, {mean('speed_over_limit_kmh', 'avg_over_limit')}, count(*) FILTER (speed_over_limit_kmh > 10) AS speeding_detections FROM det JOIN vehicle USING (vehicle_type_key) GROUP BY ALL")(
    using(marts.mart_vehicle_stats, T.detections, T.vehicles)
)
bind("m8_by_weather", f"SELECT condition_name, precip_band, is_severe, {TOTAL}, {SPEED}, {JAM} FROM fht JOIN weather USING (weather_key) WHERE vehicle_count > 0 GROUP BY ALL")(using(marts.mart_by_weather, T.hourly, T.weather))
bind("m9_by_district", f"SELECT city, district, {TOTAL}, {JAM}, {INC} FROM fht JOIN seg USING (segment_key) GROUP BY ALL")(using(marts.mart_by_district, T.hourly, T.segments))
bind("m10_by_weekday", f"SELECT day_of_week, day_name, {TOTAL}, {SPEED}, {JAM} FROM fht JOIN date USING (date_key) GROUP BY ALL")(using(marts.mart_by_weekday, T.hourly, T.dates))
bind("m11_light_performance", f"SELECT controller_code, end_intersection, current_timing_plan, previous_timing_plan, timing_plan_changed, cycle_seconds, sum(vehicle_count)::BIGINT AS approach_volume, {W('congestion_index', 'avg_approach_congestion')}, sum(vehicle_count)::BIGINT * max(cycle_seconds) / (count(*) * 3600) AS vehicles_per_cycle FROM fht JOIN seg USING (segment_key) JOIN light ON intersection_name = end_intersection GROUP BY ALL")(
    using(marts.mart_light_performance, T.hourly, T.segments, T.lights)
)
bind("m12_emergency_response", f"SELECT year_month, category, unit_type, count(*) AS incidents, {mean('minutes_to_dispatch', 'avg_dispatch_min')}, {mean('minutes_to_arrive', 'avg_response_min')}, {mean('minutes_to_clear', 'avg_clearance_min')}, {mean('total_duration_minutes', 'avg_total_min')}, count(*) FILTER (minutes_to_arrive <= 8)::DOUBLE * 100 / nullif(count(minutes_to_arrive), 0)::DOUBLE AS response_sla_pct FROM fil JOIN idate ON date_key = detected_date_key JOIN kind USING (incident_type_key) JOIN unit USING (unit_key) GROUP BY ALL")(
    using(marts.mart_emergency_response, T.incidents, T.incident_dates, T.incident_kinds, T.units)
)
bind("m13_top_intersections", "WITH x AS (SELECT end_intersection, district, sum(vehicle_count)::BIGINT AS approach_volume, (sum(congestion_index * vehicle_count)::DOUBLE / sum(vehicle_count)::DOUBLE)::DECIMAL(4,3) AS weighted_congestion FROM fht JOIN seg USING (segment_key) WHERE congestion_index IS NOT NULL GROUP BY ALL) SELECT * FROM x QUALIFY rank() OVER (ORDER BY weighted_congestion DESC) <= 10")(
    using(marts.mart_top_intersections, T.hourly, T.segments)
)
bind("m14_fact_daily", f"SELECT date_key, full_date, day_name, is_weekend, {TOTAL}, {SPEED}, {JAM}, {HEAVY}, {INC} FROM fht JOIN date USING (date_key) GROUP BY ALL")(using(marts.mart_fact_daily, T.hourly, T.dates))
bind("x4_accident_rate", "WITH v AS (SELECT road_name, sum(vehicle_count * length_m)::BIGINT AS vehicle_m FROM fht JOIN seg USING (segment_key) GROUP BY ALL), n AS (SELECT road_name, count(*) AS incidents FROM fil JOIN seg USING (segment_key) GROUP BY ALL) SELECT road_name, vehicle_m, coalesce(incidents, 0) AS incidents, coalesce(incidents, 0)::DOUBLE * 1e9 / nullif(vehicle_m, 0)::DOUBLE AS per_million_vehicle_km FROM v LEFT JOIN n USING (road_name)")(
    using(marts.accident_rate, T.incidents, T.hourly, T.segments)
)

# ---------------------------------------------------------------- KPIs

bind("kp1_segment_daily", "WITH x AS (SELECT event_date, segment_code, sum(vehicle_count)::BIGINT AS day_volume, sum(avg_speed)::DOUBLE / count(avg_speed)::DOUBLE AS avg_speed, arg_max(hour_of_day, vehicle_count * 100 - hour_of_day) AS peak_hour, max(vehicle_count) AS peak_hour_volume FROM fht GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY event_date ORDER BY day_volume DESC) AS volume_rank, day_volume - lag(day_volume) OVER (PARTITION BY segment_code ORDER BY event_date) AS volume_delta FROM x")(
    using(kpis.kpi_segment_daily, T.hourly)
)
bind("kp2_weather_penalty", "WITH x AS (SELECT segment_code, condition_code, sum(avg_speed)::DOUBLE / count(*)::DOUBLE AS avg_speed FROM fht GROUP BY ALL), y AS (SELECT *, max(CASE WHEN condition_code = 'DRY' THEN avg_speed END) OVER (PARTITION BY segment_code) AS dry_baseline FROM x) SELECT *, (dry_baseline - avg_speed) * 100 / dry_baseline AS speed_penalty_pct FROM y WHERE condition_code <> 'DRY' AND dry_baseline IS NOT NULL")(
    using(kpis.kpi_weather_penalty, T.hourly)
)
bind("kp3_rush_hours", "WITH x AS (SELECT segment_code, dayofweek(event_date) + 1 AS weekday, hour_of_day AS predicted_peak_hour, quantile_disc(vehicle_count, 0.85) AS p85_volume FROM fht GROUP BY ALL) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY segment_code, weekday ORDER BY p85_volume DESC, predicted_peak_hour) <= 3")(
    using(kpis.kpi_rush_hours, T.hourly)
)

# ---------------------------------------------------------------- windows and top-n

order = lambda *c: [F.desc(x[1:]) if x[0] == "-" else F.asc(x) for x in c]
later = lambda *c: lambda: order(*c)
VOLUME = "v AS (SELECT district, road_name, segment_code, sum(vehicle_count)::BIGINT AS n FROM fht JOIN seg USING (segment_key, segment_code) GROUP BY ALL)"
volume = lambda s, d: T.hourly(s, d).join(T.segments(s, d), ["segment_key", "segment_code"]).groupBy("district", "road_name", "segment_code").agg(F.sum("vehicle_count").alias("n"))
ROADS = "r AS (SELECT road_name, sum(congestion_index * vehicle_count)::DOUBLE / sum(vehicle_count)::DOUBLE AS congestion FROM fht JOIN seg USING (segment_key) GROUP BY ALL)"
roads = lambda s, d: A.weighted_avg(T.hourly(s, d).join(T.segments(s, d), "segment_key"), ("road_name",), {"congestion_index": "congestion"}, "vehicle_count", "_n").drop("_n")
DAILY = "dd AS (SELECT segment_code, event_date, sum(vehicle_count)::BIGINT AS n FROM fht GROUP BY ALL)"
daily = lambda s, d: T.hourly(s, d).groupBy("segment_code", "event_date").agg(F.sum("vehicle_count").alias("n"))

bind("w1_top3_per_district", f"WITH {VOLUME} SELECT *, row_number() OVER w AS rank FROM v WINDOW w AS (PARTITION BY district ORDER BY n DESC, segment_code) QUALIFY row_number() OVER w <= 3")(
    using(A.top_n_per_group, volume, by=("district",), order=later("-n", "segment_code"), n=3)
)
bind("w2_rank_and_dense_rank", f"WITH {ROADS} SELECT *, rank() OVER (ORDER BY congestion DESC) AS rank_with_gaps, dense_rank() OVER (ORDER BY congestion DESC) AS rank_no_gaps FROM r")(using(A.rank_both, roads, measure="congestion"))
bind("w3_ntile", f"WITH {VOLUME} SELECT *, ntile(4) OVER (ORDER BY n DESC, segment_code) AS bucket FROM v")(using(A.quantile_bucket, volume, order=later("-n", "segment_code"), n=4))
bind("w4_running_share", "SELECT segment_code, hour_of_day, vehicle_count, sum(vehicle_count) OVER (PARTITION BY segment_code ORDER BY hour_of_day ROWS UNBOUNDED PRECEDING)::BIGINT AS running, sum(vehicle_count) OVER (PARTITION BY segment_code ORDER BY hour_of_day ROWS UNBOUNDED PRECEDING)::DOUBLE * 100 / sum(vehicle_count) OVER (PARTITION BY segment_code)::DOUBLE AS pct_of_total FROM fht WHERE date_key = (SELECT max(date_key) FROM fht)")(
    lambda s, d: (lambda h: A.running_share(h.join(F.broadcast(h.agg(F.max("date_key").alias("date_key"))), "date_key").select("segment_code", "hour_of_day", "vehicle_count"), ("segment_code",), ("hour_of_day",), "vehicle_count"))(T.hourly(s, d))
)
bind("w5_moving_avg", "SELECT segment_code, event_date, hour_of_day, avg_speed, sum(avg_speed) OVER w::DOUBLE / count(avg_speed) OVER w AS moving_avg FROM fht WINDOW w AS (PARTITION BY segment_code ORDER BY event_date, hour_of_day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")(
    lambda s, d: A.moving_avg(T.hourly(s, d).select("segment_code", "event_date", "hour_of_day", "avg_speed"), ("segment_code",), ("event_date", "hour_of_day"), "avg_speed", 3, 3)
)
bind("w6_pct_change", f"WITH {DAILY} SELECT *, lag(n) OVER w AS previous, (n - lag(n) OVER w)::DOUBLE * 100 / nullif(lag(n) OVER w, 0)::DOUBLE AS pct_change FROM dd WINDOW w AS (PARTITION BY segment_code ORDER BY event_date)")(
    using(A.pct_change, daily, by=("segment_code",), order=("event_date",), column="n")
)
bind("w7_percentiles_with_extreme", "SELECT incident_type_key, quantile_cont(minutes_to_arrive, 0.5)::DOUBLE AS p50, quantile_cont(minutes_to_arrive, 0.9)::DOUBLE AS p90, arg_min(incident_number, incident_number - minutes_to_arrive::BIGINT * 1000000000) AS slowest FROM fil WHERE minutes_to_arrive IS NOT NULL GROUP BY ALL")(
    lambda s, d: A.percentiles(T.incidents(s, d), ("incident_type_key",), "minutes_to_arrive", {"p50": 0.5, "p90": 0.9}, F.max_by("incident_number", F.struct("minutes_to_arrive", -F.col("incident_number"))).alias("slowest"))
)
bind("w8_gap_to_next", "SELECT event_id, user_id, event_ts, lead(event_ts) OVER w AS next_ts, datediff('minute', event_ts, lead(event_ts) OVER w)::INT AS minutes_to_next FROM det WINDOW w AS (PARTITION BY user_id ORDER BY event_ts, event_id)")(
    lambda s, d: A.gap_to_next(T.detections(s, d).select("event_id", "user_id", "event_ts"), ("user_id",), "event_ts", "event_id")
)
bind("w9_first_flagged", "SELECT date_key, segment_code, min(hour_of_day) AS first_hour FROM fht WHERE avg_speed < 0.6 * speed_limit GROUP BY ALL")(
    lambda s, d: A.first_flagged(T.hourly(s, d), ("date_key", "segment_code"), F.col("avg_speed") < 0.6 * F.col("speed_limit"), "hour_of_day", "first_hour")
)
bind("w12_latest_per_key", "SELECT user_id, event_id, event_ts FROM det QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) = 1")(
    lambda s, d: A.latest_per_key(T.detections(s, d).select("user_id", "event_id", "event_ts"), ("user_id",), order("-event_ts", "-event_id"))
)
bind("t1_top_with_ties", f"WITH x AS (SELECT segment_code, {TOTAL}, {SPEED} FROM fht GROUP BY ALL) SELECT * FROM x QUALIFY rank() OVER (ORDER BY total_vehicles DESC) <= 10")(
    lambda s, d: A.top_with_ties(A.weighted_avg(T.hourly(s, d), ("segment_code",), marts.SPEED, "vehicle_count", "total_vehicles"), "total_vehicles", 10)
)
bind("t2_top5_weighted", "WITH x AS (SELECT region, nation, sum(quantity)::BIGINT AS quantity, sum(price * quantity)::DOUBLE / sum(quantity)::DOUBLE AS price FROM sales GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY region ORDER BY price DESC, nation) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY region ORDER BY price DESC, nation) <= 5")(
    lambda s, d: A.top_n_per_group(A.weighted_avg(T.sales(s, d), ("region", "nation"), {"price": "price"}, "quantity", "quantity"), ("region",), order("-price", "nation"), 5)
)
bind("t3_top_percent", "SELECT segment_code, event_date, hour_of_day, congestion_index FROM fht WHERE vehicle_count >= 2 ORDER BY congestion_index DESC, segment_code, event_date, hour_of_day LIMIT (SELECT ceil(count(*) * 5 / 100)::BIGINT FROM fht WHERE vehicle_count >= 2)")(
    lambda s, d: A.top_percent(T.hourly(s, d).where("vehicle_count >= 2").select("segment_code", "event_date", "hour_of_day", "congestion_index"), order("-congestion_index", "segment_code", "event_date", "hour_of_day"), 5)
)
NESTED = "WITH b AS (SELECT nation, sum(quantity)::BIGINT AS outer_total FROM sales GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5), m AS (SELECT nation, month, sum(quantity)::BIGINT AS n FROM sales GROUP BY ALL) SELECT nation, month, n, outer_total, row_number() OVER (PARTITION BY nation ORDER BY n DESC, month) AS rank FROM m JOIN b USING (nation) QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, month) <= 3"
bind("t4_nested_top_n", NESTED)(lambda s, d: A.nested_top_n(T.sales(s, d).groupBy("nation", "month").agg(F.sum("quantity").alias("n")), "nation", "n", 5, order("-n", "month"), 3))
bind("t5_top_n", f"WITH {VOLUME} SELECT * FROM v ORDER BY n DESC, segment_code LIMIT 10")(using(A.top_n, volume, order=later("-n", "segment_code"), n=10))
SPINE = "sp AS (SELECT k.date_key, g.segment_code, r.h::INT AS hour_of_day, coalesce(f.vehicle_count, 0)::BIGINT AS vehicle_count FROM (SELECT DISTINCT date_key FROM fht) k CROSS JOIN (SELECT DISTINCT segment_code FROM seg) g CROSS JOIN range(24) r(h) LEFT JOIN fht f ON f.date_key = k.date_key AND f.segment_code = g.segment_code AND f.hour_of_day = r.h)"


def spine(s: SparkSession, d: str) -> DataFrame:
    h = T.hourly(s, d).select("date_key", "segment_code", "hour_of_day", "vehicle_count")
    members = T.segments(s, d).select("segment_code").crossJoin(F.broadcast(T.dates(s, d).select("date_key")))  # a row a day
    return joins.dense_spine(members, range(24), "hour_of_day", h, ("date_key", "segment_code", "hour_of_day"), ("vehicle_count",)).select("date_key", "segment_code", "hour_of_day", "vehicle_count")


bind("j11_dense_spine", f"WITH {SPINE} SELECT * FROM sp")(spine)
bind("t6_busiest_with_gaps", f"WITH {SPINE}, l AS (SELECT * FROM sp WHERE date_key = (SELECT max(date_key) FROM sp)), b AS (SELECT segment_code FROM l GROUP BY 1 HAVING count(*) FILTER (vehicle_count = 0) > 0 ORDER BY sum(vehicle_count) DESC, 1 LIMIT 1) SELECT segment_code, date_key, hour_of_day, vehicle_count FROM l JOIN b USING (segment_code)")(
    using(A.busiest_with_gaps, spine, day="date_key", entity="segment_code", slot="hour_of_day", count="vehicle_count")
)

# ---------------------------------------------------------------- cleansing, rules, duplicates

DIRTY = """
d0 AS (SELECT event_id, event_ts, event_date, event_date + (CASE WHEN event_id % 71 = 0 THEN 1 ELSE 0 END)::INT AS ingest_date, CASE WHEN event_id % 97 = 0 THEN ' n/a ' ELSE ' u' || user_id || ' ' END AS raw_code,
  CASE WHEN event_id % 89 = 0 THEN 999 ELSE speed_kmh END::DECIMAL(7,2) AS speed_kmh, CASE WHEN event_id % 61 = 0 THEN 150 ELSE occupancy_pct END AS occupancy_pct,
  CASE WHEN event_id % 53 = 0 THEN 'XX' ELSE (['NB', 'SB', 'EB', 'WB'])[event_id % 4 + 1] END AS direction, r.copy, 'f' || r.copy AS _source_file
  FROM det CROSS JOIN range(2) r(copy) WHERE r.copy = 0 OR event_id % 83 = 0),
d1 AS (SELECT *, CASE WHEN upper(trim(raw_code)) IN ('', 'N/A', 'NA', '-', 'NULL') THEN NULL ELSE upper(trim(raw_code)) END AS detector_code FROM d0),
d2 AS (SELECT *, CASE WHEN detector_code IS NULL THEN 'MISSING_KEY' WHEN speed_kmh <= 0 OR speed_kmh > 250 THEN 'SPEED_RANGE' WHEN occupancy_pct < 0 OR occupancy_pct > 100 THEN 'OCCUPANCY_RANGE'
  WHEN event_ts > TIMESTAMP '2024-01-29' THEN 'FUTURE_TIMESTAMP' WHEN event_date <> ingest_date THEN 'DATE_MISMATCH' WHEN direction NOT IN ('NB', 'SB', 'EB', 'WB') THEN 'BAD_DIRECTION' END AS rule FROM d1),
dirty AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_id ORDER BY event_ts DESC, _source_file, detector_code) > 1 THEN 'DUPLICATE' ELSE rule END AS reject_reason FROM d2)"""


def dirty(s: SparkSession, d: str) -> DataFrame:
    """Events with defects, normalised, each with the first rule that it breaks."""
    k = F.col("event_id")
    raw = T.detections(s, d).withColumn("copy", F.explode(F.when(k % 83 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "event_id", F.col("event_ts").cast("timestamp").alias("event_ts"), "event_date", F.date_add("event_date", F.when(k % 71 == 0, 1).otherwise(0)).alias("ingest_date"), F.when(k % 97 == 0, " n/a ").otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit(" "))).alias("detector_code"),
        F.when(k % 89 == 0, F.lit(999)).otherwise(F.col("speed_kmh")).cast("decimal(7,2)").alias("speed_kmh"), F.when(k % 61 == 0, 150).otherwise(F.col("occupancy_pct")).alias("occupancy_pct"),
        F.when(k % 53 == 0, "XX").otherwise(F.element_at(F.array(*[F.lit(x) for x in C.DIRECTIONS]), (k % 4 + 1).cast("int"))).alias("direction"), F.concat(F.lit("f"), F.col("copy").cast("string")).alias("_source_file"),
    )
    return cleanse.apply_rules(cleanse.normalize(raw, ("detector_code",)), C.event_rules(now=F.lit("2024-01-29").cast("timestamp")))


labelled = lambda s, d: cleanse.label_duplicates(dirty(s, d), ("event_id",), cleanse.event_order())
bind("p1_normalize", f", {DIRTY} SELECT event_id, _source_file, detector_code FROM d1")(lambda s, d: dirty(s, d).select("event_id", "_source_file", "detector_code"))
bind("v1_rules", f", {DIRTY} SELECT event_id, _source_file, rule AS reject_reason FROM d2")(lambda s, d: dirty(s, d).select("event_id", "_source_file", "reject_reason"))
for _n, _r in (("v2_missing_key", "MISSING_KEY"), ("v3_speed_range", "SPEED_RANGE"), ("v4_occupancy_range", "OCCUPANCY_RANGE"), ("v5_future_timestamp", "FUTURE_TIMESTAMP"), ("v6_date_mismatch", "DATE_MISMATCH"), ("v7_bad_direction", "BAD_DIRECTION")):
    bind(_n, f", {DIRTY} SELECT event_id, _source_file FROM d2 WHERE rule = '{_r}'")(lambda s, d, r=_r: dirty(s, d).where(F.col("reject_reason") == r).select("event_id", "_source_file"))
bind("v9_split_rejects", f", {DIRTY} SELECT event_id, detector_code FROM dirty WHERE reject_reason IS NULL")(lambda s, d: cleanse.split_rejects(labelled(s, d))[0].select("event_id", "detector_code"))
bind("v10_rejects", f", {DIRTY} SELECT 7 AS batch_id, event_id, event_ts, reject_reason, event_id || '|' || coalesce(detector_code, '') || '|' || direction AS payload FROM dirty WHERE reject_reason IS NOT NULL")(
    lambda s, d: cleanse.build_rejects(labelled(s, d), 7, ("event_id", "detector_code", "direction")).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
)
bind("d1_label_duplicates", f", {DIRTY} SELECT event_id, _source_file, reject_reason FROM dirty")(lambda s, d: labelled(s, d).select("event_id", "_source_file", "reject_reason"))
bind("d2_keep_first", f", {DIRTY} SELECT event_id, _source_file FROM dirty WHERE reject_reason IS DISTINCT FROM 'DUPLICATE'")(lambda s, d: cleanse.keep_first(dirty(s, d), ("event_id",), cleanse.event_order()).select("event_id", "_source_file"))
bind("r1_reconcile", f", {DIRTY} SELECT ingest_date, count(*) AS rows_in, count(*) FILTER (reject_reason IS NULL) AS rows_good, count(*) FILTER (reject_reason IS NOT NULL) AS rows_quarantined, true AS balanced FROM dirty GROUP BY ALL")(using(cleanse.reconcile, labelled))
metrics = lambda s, d: cleanse.reject_metrics(cleanse.split_rejects(labelled(s, d))[1])
bind("a11_reject_metrics", f", {DIRTY} SELECT ingest_date, reject_reason, count(*) AS rejected_rows FROM dirty WHERE reject_reason IS NOT NULL GROUP BY ALL")(metrics)
PIVOT = ", ".join(f"coalesce(sum(CASE WHEN reject_reason = '{r}' THEN rejected_rows END), 0)::BIGINT AS \"{r}\"" for r in kpis.REASONS)
bind("kp4_quality_daily", f", {DIRTY}, m AS (SELECT ingest_date, reject_reason, count(*) AS rejected_rows FROM dirty WHERE reject_reason IS NOT NULL GROUP BY ALL), p AS (SELECT ingest_date AS load_date, {PIVOT} FROM m GROUP BY 1), g AS (SELECT event_date AS load_date, sum(vehicle_count)::BIGINT AS valid_detections FROM fht GROUP BY 1) SELECT load_date, {', '.join(f'coalesce({chr(34)}{r}{chr(34)}, 0) AS {chr(34)}{r}{chr(34)}' for r in kpis.REASONS)}, coalesce(valid_detections, 0) AS valid_detections FROM p FULL JOIN g USING (load_date)")(
    lambda s, d: kpis.quality_daily(metrics(s, d), T.hourly(s, d))
)
bind("p4_bands", "SELECT event_id, CASE WHEN value < -5 THEN 'Below -5' WHEN value < 5 THEN '-5 to 5' WHEN value < 15 THEN '5 to 15' WHEN value < 25 THEN '15 to 25' ELSE 'Above 25' END AS temp, CASE WHEN value = 0 THEN 'None' WHEN value < 2.5 THEN 'Light' WHEN value < 7.5 THEN 'Moderate' ELSE 'Heavy' END AS precip, CASE WHEN value * 20 >= 2000 THEN 'Good' WHEN value * 20 >= 500 THEN 'Reduced' ELSE 'Poor' END AS vis FROM events", False)(
    lambda s, d: T.table(s, d, "events").select("event_id", C.band_temperature(F.col("value")).alias("temp"), C.band_precipitation(F.col("value")).alias("precip"), C.band_visibility(F.col("value") * 20).alias("vis"))
)
bind("p5_over_limit", "SELECT event_id, speed_over_limit_kmh FROM det")(lambda s, d: T.detections(s, d).select("event_id", "speed_over_limit_kmh"))
bind("p6_congestion_index", "SELECT date_key, hour_of_day, segment_code, congestion_index FROM fht")(lambda s, d: T.hourly(s, d).select("date_key", "hour_of_day", "segment_code", "congestion_index"))
bind("u2_labelled_union", "SELECT 'events' AS label, event_type AS kind, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'orders', o_orderpriority, count(*) FROM orders GROUP BY ALL", False)(
    lambda s, d: cleanse.labelled_union({"events": T.table(s, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")), "orders": T.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))})
)

# ---------------------------------------------------------------- joins

bind("j2_star_join", "SELECT road_name, condition_name, count(*) AS n FROM det JOIN seg USING (segment_key) JOIN weather USING (weather_key) GROUP BY ALL")(
    lambda s, d: joins.star_join(T.detections(s, d), {"segment_key": T.segments(s, d), "weather_key": T.weather(s, d)}).groupBy("road_name", "condition_name").agg(F.count("*").alias("n"))
)
bind("j3_lookup_key", "SELECT o_orderkey, coalesce(c_custkey, -1) AS customer_key FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0", False)(
    lambda s, d: joins.lookup_key(T.table(s, d, "orders"), T.table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("code"), F.col("c_custkey").alias("customer_key")), {"o_custkey": "code"}, "customer_key").select("o_orderkey", "customer_key")
)
SCD = """
old AS (SELECT c_custkey, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 11 <> 0),
new AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer),
ver AS (
  SELECT o.c_custkey, o.segment, DATE '1995-01-01' AS effective_date, CASE WHEN n.segment <> o.segment THEN DATE '1997-12-31' ELSE DATE '9999-12-31' END AS expiration_date, n.segment = o.segment AS is_current, 1 AS version_number, o.segment AS original_segment, n.segment AS current_segment
  FROM old o JOIN new n USING (c_custkey)
  UNION ALL SELECT n.c_custkey, n.segment, DATE '1998-01-01', DATE '9999-12-31', true, 2, o.segment, n.segment FROM old o JOIN new n USING (c_custkey) WHERE n.segment <> o.segment
  UNION ALL SELECT c_custkey, segment, DATE '1998-01-01', DATE '9999-12-31', true, 1, segment, segment FROM new WHERE c_custkey % 11 = 0)"""


def customer_dim(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(the dimension after the first day, the source of the second)."""
    c = T.table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    first = dimensions.first_versions(c.where("c_custkey % 11 <> 0"), "c_custkey", "customer_key", ("segment", "nation"), "1995-01-01", {"original_segment": F.col("segment"), "current_segment": F.col("segment")})
    return first, c.withColumn("segment", F.when(F.col("c_custkey") % 10 == 0, "CHANGED").otherwise(F.col("segment")))


def versions(s: SparkSession, d: str) -> DataFrame:
    dim, source = customer_dim(s, d)
    return dimensions.scd2_merge(dim, source, "c_custkey", "customer_key", ("segment", "nation"), "1998-01-01", type0={"original_segment": "segment"}, type6={"current_segment": "segment"})


SHOWN = ("c_custkey", "segment", "effective_date", "expiration_date", "is_current", "version_number", "original_segment", "current_segment")
bind("c2_scd2_merge", f"WITH {SCD} SELECT * FROM ver", True)(lambda s, d: versions(s, d).select(*SHOWN))
bind("c2_scd2_rerun", f"WITH {SCD} SELECT * FROM ver", True)(
    lambda s, d: dimensions.scd2_merge(versions(s, d), customer_dim(s, d)[1], "c_custkey", "customer_key", ("segment", "nation"), "1998-01-01", type0={"original_segment": "segment"}, type6={"current_segment": "segment"}).select(*SHOWN)
)
bind("c9_most_versioned", f"WITH {SCD} SELECT c_custkey, count(*) AS versions FROM ver GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10")(using(dimensions.most_versioned, versions, business_key="c_custkey"))
bind("j4_pit_join", f"WITH {SCD} SELECT o_orderkey, ver.segment, ver.version_number FROM orders LEFT JOIN ver ON o_custkey = c_custkey AND o_orderdate::DATE BETWEEN effective_date AND expiration_date")(
    lambda s, d: joins.pit_join(T.table(s, d, "orders").withColumn("day", F.to_date("o_orderdate")), versions(s, d), {"o_custkey": "c_custkey"}, "day").select("o_orderkey", "segment", "version_number")
)
bind("j15_overlapping_intervals", f"WITH {SCD}, k AS (SELECT *, c_custkey * 10 + version_number AS k FROM (SELECT c_custkey, version_number, effective_date, expiration_date + (CASE WHEN c_custkey % 20 = 0 AND version_number = 1 AND NOT is_current THEN 5 ELSE 0 END)::INT AS expiration_date FROM ver)) SELECT a.c_custkey, a.k AS first_key, b.k AS second_key FROM k a JOIN k b ON a.c_custkey = b.c_custkey AND a.k < b.k AND a.effective_date <= b.expiration_date AND b.effective_date <= a.expiration_date")(
    lambda s, d: joins.overlapping_intervals(versions(s, d).withColumns({"k": F.col("c_custkey") * 10 + F.col("version_number"), "expiration_date": F.date_add("expiration_date", F.when((F.col("c_custkey") % 20 == 0) & (F.col("version_number") == 1) & ~F.col("is_current"), 5).otherwise(0))}), "c_custkey", "k")
)
bind("c1_scd1_merge", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment FROM customer", False)(
    lambda s, d: (lambda dim, src: dimensions.scd1_merge(dim.select("customer_key", "c_custkey", "segment"), src, "c_custkey", ("segment",), "customer_key").select("c_custkey", "segment"))(*customer_dim(s, d))
)
bind("c6_scd3_merge", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 11 <> 0 THEN c_mktsegment END AS previous_segment, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 11 <> 0 THEN DATE '1998-01-01' END AS segment_changed FROM customer", False)(
    lambda s, d: (lambda dim, src: dimensions.scd3_merge(dim.select("customer_key", "c_custkey", "segment", F.lit(None).cast("string").alias("previous_segment"), F.lit(None).cast("date").alias("segment_changed")), src, "c_custkey", "segment", (), "customer_key", "1998-01-01").drop("customer_key"))(*customer_dim(s, d))
)
bind("c7_infer_members", "SELECT c_custkey, c_custkey % 11 = 0 AS is_inferred FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey IN (SELECT o_custkey FROM orders)", False)(
    lambda s, d: dimensions.infer_members(T.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), customer_dim(s, d)[0], "c_custkey", "customer_key", {"segment": "UNKNOWN"}, "1995-01-01").select("c_custkey", "is_inferred")
)
bind("j6_asof_join", "SELECT e.event_id, v.event_id AS right_event_id FROM (SELECT * FROM det WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM det WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.event_ts >= v.event_ts")(
    lambda s, d: joins.asof_join(T.detections(s, d).where("event_type = 'error'").select("event_id", "user_id", "event_ts"), T.detections(s, d).where("event_type = 'view'"), "event_ts", "event_ts", ("user_id",), ("event_id",), ("event_id",)).select("event_id", "right_event_id")
)
bind("j6_asof_join_unkeyed", "SELECT e.event_id, v.event_id AS right_event_id FROM (SELECT * FROM det WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM det WHERE event_type = 'view') v ON e.event_ts >= v.event_ts")(
    lambda s, d: joins.asof_join_unkeyed(T.detections(s, d).where("event_type = 'error'").select("event_id", "event_ts"), T.detections(s, d).where("event_type = 'view'"), "event_ts", "event_ts", ("event_id",), ("event_id",)).select("event_id", "right_event_id")
)
TIED = "v AS (SELECT event_id, 'k' || event_id % 13 AS station, date_trunc('hour', event_ts) AS seen FROM det WHERE event_type = 'view'), one AS (SELECT seen, min(station) AS station FROM v GROUP BY seen)"
bind("j6_asof_join_ties", f"WITH {TIED} SELECT e.event_id, one.station AS right_station FROM (SELECT * FROM det WHERE event_type = 'error') e ASOF LEFT JOIN one ON e.event_ts >= one.seen")(
    lambda s, d: joins.asof_join_unkeyed(T.detections(s, d).where("event_type = 'error'").select("event_id", "event_ts"), T.detections(s, d).where("event_type = 'view'").select(F.date_trunc("hour", "event_ts").alias("at"), F.concat(F.lit("k"), (F.col("event_id") % 13).cast("string")).alias("station")), "event_ts", "at", ("station",), ("station",)).select("event_id", "right_station")
)
bind("j6_asof_join_keyed_ties", "WITH v AS (SELECT user_id, 'k' || event_id % 13 AS station, date_trunc('day', event_ts) AS seen FROM det WHERE event_type = 'view'), one AS (SELECT user_id, seen, min(station) AS station FROM v GROUP BY ALL) SELECT e.event_id, one.station AS right_station FROM (SELECT * FROM det WHERE event_type = 'error') e ASOF LEFT JOIN one ON e.user_id = one.user_id AND e.event_ts >= one.seen")(
    lambda s, d: joins.asof_join(T.detections(s, d).where("event_type = 'error'").select("event_id", "user_id", "event_ts"), T.detections(s, d).where("event_type = 'view'").select("user_id", F.date_trunc("day", "event_ts").cast("timestamp_ntz").alias("at"), F.concat(F.lit("k"), (F.col("event_id") % 13).cast("string")).alias("station")), "event_ts", "at", ("user_id",), ("station",), (F.col("station"),)).select("event_id", "right_station")
)
LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
bind("j7_first_per_parent", f"SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) = 1) ON l_orderkey = o_orderkey", False)(
    lambda s, d: joins.first_per_parent(T.table(s, d, "orders").select("o_orderkey"), T.table(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", LINE.split(", "), ("l_linenumber", "l_partkey"))
)
bind("j8_denormalized", "SELECT o_orderkey, c_name AS customer, n.n_name AS nation, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", False)(
    lambda s, d: joins.denormalized(T.table(s, d, "orders"), (T.table(s, d, "customer"), "o_custkey", "c_custkey", {"c_name": "customer", "c_nationkey": "nk"}), (T.table(s, d, "nation"), "nk", "n_nationkey", {"n_name": "nation", "n_regionkey": "rk"}), (T.table(s, d, "region"), "rk", "r_regionkey", {"r_name": "region"})).select("o_orderkey", "customer", "nation", "region")
)
bind("j12_missing_members", "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey % 11 = 0", False)(
    lambda s, d: joins.missing_members(T.table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), customer_dim(s, d)[0], "c_custkey")
)
bind("j12_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey % 11 = 0", False)(lambda s, d: joins.orphans(T.table(s, d, "orders"), customer_dim(s, d)[0], "o_custkey", "c_custkey").select("o_orderkey"))
bind("j13_filter_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", False)(
    lambda s, d: joins.filter_exists(T.table(s, d, "customer"), T.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")
)
bind("j16_role_join", "SELECT year_month, count(*) AS closed FROM fil JOIN idate ON closed_date_key = date_key GROUP BY ALL")(
    lambda s, d: joins.role_join(T.incidents(s, d), T.incident_dates(s, d), "closed_date_key", "date_key", "closed_", ("year_month",)).groupBy(F.col("closed_year_month").alias("year_month")).agg(F.count("*").alias("closed"))
)
bind("j17_stamp_counts", "SELECT segment_code, (SELECT count(*) FROM fil WHERE fil.segment_key = seg.segment_key AND severity = 4) AS incident_count FROM seg")(
    lambda s, d: joins.stamp_counts(T.segments(s, d), T.incidents(s, d).where("severity = 4"), ("segment_key",), "incident_count").select("segment_code", "incident_count")
)
bind("j19_scalar", "SELECT segment_code, n FROM (SELECT segment_code, sum(vehicle_count)::BIGINT AS n FROM fht GROUP BY 1) WHERE n > (SELECT avg(n) FROM (SELECT sum(vehicle_count) AS n FROM fht GROUP BY segment_code))")(
    lambda s, d: (lambda v: joins.with_scalar(v, F.avg("n"), "_mean").where("n > _mean").drop("_mean"))(volume(s, d).select("segment_code", "n"))
)

# ---------------------------------------------------------------- facts

FACTS = "incident_number, detected_date_key, detected_time_key, dispatched_date_key, dispatched_time_key, arrived_date_key, cleared_date_key, closed_date_key, closed_time_key, minutes_to_dispatch, minutes_to_arrive, minutes_to_clear, total_duration_minutes"
bind("f3_lifecycle", f"SELECT {FACTS} FROM fil")(lambda s, d: T.incidents(s, d).select(*FACTS.split(", ")))


def upserted(s: SparkSession, d: str) -> DataFrame:
    """The first load knew no milestone but the first; the second brings the rest and the incidents that were held back."""
    src = T.incident_source(s, d)
    early = src.where("incident_number % 5 <> 0").withColumns({c: F.lit(None).cast("timestamp") for c in ("dispatched_ts", "arrived_ts", "cleared_ts", "closed_ts")} | {"severity": F.lit(9).cast("long"), "segment_key": F.lit(7).cast("long")})
    return facts.lifecycle(facts.upsert_lifecycle(early, src)).select("incident_number", "segment_key", "severity", "minutes_to_dispatch", "closed_date_key")


bind("f3_upsert_lifecycle", "SELECT incident_number, CASE WHEN incident_number % 5 <> 0 THEN 7 ELSE segment_key END AS segment_key, severity, minutes_to_dispatch, closed_date_key FROM fil")(upserted)
bind("f4_keys", "SELECT event_id, date_key, time_key FROM det")(lambda s, d: T.detections(s, d).select("event_id", "date_key", "time_key"))
bind("f5_minute_lag", "SELECT incident_number, datediff('minute', detected_ts, closed_ts)::INT AS lag FROM fil")(lambda s, d: T.incidents(s, d).select("incident_number", C.minute_lag(F.col("detected_ts"), F.col("closed_ts")).alias("lag")))

# ---------------------------------------------------------------- spines and graphs

bind("g3_date_gaps", "WITH f AS (SELECT DISTINCT event_date FROM det WHERE day(event_date) NOT IN (5, 6, 17)), b AS (SELECT min(event_date) AS lo, max(event_date) AS hi FROM f) SELECT unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day, 'MISSING' AS verdict FROM b EXCEPT SELECT event_date, 'MISSING' FROM f")(
    lambda s, d: (lambda t: spines.date_gaps(t.where("day(event_date) not in (5, 6, 17)"), "event_date", t, "event_date"))(T.detections(s, d))
)
DIMDATE = "SELECT date_key, year, month_number, week_of_year, day_of_week, day_name, is_weekend, is_holiday, holiday_name, season, n"


def calendar_join(s: SparkSession, d: str) -> DataFrame:
    """Orders a day beside the calendar, which spans the days that orders have."""
    daily_orders = T.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("full_date")).agg(F.count("*").alias("n"))
    span = daily_orders.agg(F.min("full_date").alias("lo"), F.max("full_date").alias("hi")).first()
    return spines.build_dim_date(s, str(span.lo), str(span.hi)).join(daily_orders, "full_date").select(*DIMDATE[7:].split(", "))


bind("g4_calendar_join", "WITH x AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1) SELECT strftime(d, '%Y%m%d')::INT AS date_key, year(d) AS year, month(d) AS month_number, weekofyear(d) AS week_of_year, isodow(d) AS day_of_week, dayname(d) AS day_name, (isodow(d) > 5)::INT AS is_weekend, (strftime(d, '%m%d') IN ('0101', '0524', '0802', '0908', '1011', '1223'))::INT AS is_holiday, CASE strftime(d, '%m%d') WHEN '0101' THEN 'New Year''s Day' WHEN '0524' THEN 'St. Cyril and Methodius' WHEN '0802' THEN 'Republic Day (Ilinden)' WHEN '0908' THEN 'Independence Day' WHEN '1011' THEN 'Uprising Day' WHEN '1223' THEN 'Referendum Day' END AS holiday_name, (['Winter', 'Spring', 'Summer', 'Autumn'])[month(d) % 12 // 3 + 1] AS season, n FROM x", False)(
    calendar_join
)
bind("g5_time_join", "SELECT CASE WHEN t < 360 THEN 'Night' WHEN t < 600 THEN 'Morning' WHEN t < 840 THEN 'Midday' WHEN t < 1080 THEN 'Afternoon' WHEN t < 1320 THEN 'Evening' ELSE 'Night' END AS day_part, (t BETWEEN 420 AND 539 OR t BETWEEN 960 AND 1109)::INT AS is_rush_hour, lpad((t // 60)::VARCHAR, 2, '0') || ':00 - ' || lpad(((t // 60 + 1) % 24)::VARCHAR, 2, '0') || ':00' AS hour_band, count(*) AS n FROM (SELECT time_key AS t FROM det) GROUP BY ALL")(
    lambda s, d: T.detections(s, d).join(spines.build_dim_time(s), "time_key").groupBy("day_part", "is_rush_hour", "hour_band").agg(F.count("*").alias("n"))
)
bind("g7_unknown_member", "SELECT segment_key, segment_code, speed_limit FROM seg UNION ALL SELECT -1, 'UNKNOWN', NULL")(
    lambda s, d: spines.with_unknown_member(spines.with_unknown_member(T.segments(s, d).select("segment_key", "segment_code", "speed_limit"), "segment_key", {"segment_code": "UNKNOWN"}), "segment_key", {"segment_code": "UNKNOWN"})
)
EDGES = "m AS (SELECT segment_key AS src, lead(segment_key) OVER (PARTITION BY event_id // 64 ORDER BY event_ts, event_id) AS dst FROM det), w AS (SELECT src, dst, count(*) AS n FROM m WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), g AS (SELECT src, dst, src || '>' || dst AS edge, 1000 // n + 1 AS length FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 3)"


def edges(s: SparkSession, d: str) -> DataFrame:
    """Moves between segments: of each segment the three that most often follow it in time within blocks of 64 event numbers; frequent moves are short."""
    follows = F.lead("segment_key").over(Window.partitionBy(F.floor(F.col("event_id") / 64)).orderBy("event_ts", "event_id"))
    moves = T.detections(s, d).select(F.col("segment_key").alias("src"), follows.alias("dst")).where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    best = A.top_n_per_group(moves, ("src",), order("-n", "dst"), 3)
    return best.select("src", "dst", F.concat_ws(">", "src", "dst").alias("edge"), (F.floor(F.lit(1000) / F.col("n")) + 1).alias("length"))


bind("g1_reachable", "WITH RECURSIVE " + EDGES + ", r AS (SELECT 1 AS hop, edge, dst, [edge] AS path FROM g WHERE src = 1 UNION ALL SELECT hop + 1, g.edge, g.dst, list_append(path, g.edge) FROM r JOIN g ON g.src = r.dst WHERE hop < 4 AND NOT list_contains(path, g.edge)) SELECT hop, edge, array_to_string(path, ' ') AS path FROM r")(
    lambda s, d: spines.reachable(edges(s, d), 1, 4).withColumn("path", F.array_join("path", " "))
)
bind("g2_routes", "WITH RECURSIVE " + EDGES + ", r AS (SELECT dst AS here, 1 AS hops, [src, dst] AS path, length FROM g WHERE src = 1 UNION ALL SELECT g.dst, hops + 1, list_append(path, g.dst), r.length + g.length FROM r JOIN g ON g.src = r.here WHERE hops < 5 AND NOT list_contains(path, g.dst) AND r.here <> 9) SELECT array_to_string(path, '>') AS route, hops, length FROM r WHERE here = 9 ORDER BY length, hops, route LIMIT 10")(
    using(spines.routes, edges, start=1, end=9, max_edges=5, k=10)
)

# ---------------------------------------------------------------- BI views and measures

bind("b12_hourly", "SELECT date_key, hour_of_day, segment_key, weather_key, vehicle_count, heavy_vehicle_count, incident_count, avg_speed, p85_speed, avg_occupancy, congestion_index, avg_temp_c, precipitation_mm FROM fht")(using(lambda h: semantic.bi_view("hourly", h), T.hourly))
bind("b13_incidents", "SELECT incident_number, CASE WHEN minutes_to_arrive IS NOT NULL THEN (minutes_to_arrive <= 8)::INT END AS met_response_sla, CASE WHEN minutes_to_clear IS NOT NULL THEN (minutes_to_clear <= 45)::INT END AS met_clearance_sla, (closed_date_key <> -1)::INT AS is_closed FROM fil")(
    lambda s, d: semantic.bi_incidents(T.incidents(s, d)).select("incident_number", "met_response_sla", "met_clearance_sla", "is_closed")
)
bind("b14_traffic_daily", f"SELECT date_key, segment_key, vehicle_type_key, weather_key, count(*) AS detections, {mean('speed_kmh', 'avg_speed')}, max(speed_kmh) AS max_speed, count(*) FILTER (speed_over_limit_kmh > 0) AS speeding_detections, {mean('occupancy_pct', 'avg_occupancy')}, {mean('headway_seconds', 'avg_headway_seconds')} FROM det GROUP BY ALL")(using(semantic.bi_traffic_daily, T.detections))
for _n, _t, _k in (("b15_sensor_daily", "SENSOR", "sensor_key"), ("b16_camera_daily", "CAMERA", "camera_key")):
    bind(_n, f"SELECT date_key, {_k}, count(*) AS detections, count(DISTINCT time_key // 60) AS active_hours, {mean('speed_kmh', 'avg_speed')}, count(*) FILTER (speed_over_limit_kmh > 0) AS speeding_detections, count(DISTINCT time_key // 60)::DOUBLE * 100.0 / 24 AS uptime_pct FROM det WHERE detector_type = '{_t}' GROUP BY ALL")(
        lambda s, d, t=_t, k=_k: semantic.bi_detector_daily(T.detections(s, d), t, k)
    )
bind("x1_detector_mix", "SELECT detector_type, count(*) AS detections FROM det GROUP BY ALL")(using(semantic.detector_mix, T.detections))
bind("x1_fact_grains", "SELECT 'events' AS fact, count(*) AS rows FROM det UNION ALL SELECT 'hourly', count(*) FROM fht UNION ALL SELECT 'incidents', count(*) FROM fil")(
    lambda s, d: semantic.fact_grains(events=T.detections(s, d), hourly=T.hourly(s, d), incidents=T.incidents(s, d))
)
bind("x3_year_over_year", "WITH y AS (SELECT year, sum(quantity)::BIGINT AS total FROM sales GROUP BY 1) SELECT y.year, y.total, p.total AS previous, (y.total - p.total)::DOUBLE * 100 / nullif(p.total, 0)::DOUBLE AS yoy_pct FROM y LEFT JOIN y p ON p.year = y.year - 1")(using(semantic.year_over_year, T.sales, year="year", measure="quantity"))
for _n, _by, _sql in (
    ("heavy_share", "segment_code", "sum(heavy_vehicle_count)::DOUBLE * 100 / sum(vehicle_count)::DOUBLE AS heavy_share FROM fht"),
    ("speeding_share", "segment_code", "count(*) FILTER (speed_over_limit_kmh > 0)::DOUBLE * 100 / count(*)::DOUBLE AS speeding_share FROM det"),
    ("response_p90", "unit_key", "quantile_cont(minutes_to_arrive, 0.9)::DOUBLE AS response_p90 FROM fil"),
    ("clearance_p50", "unit_key", "quantile_cont(minutes_to_clear, 0.5)::DOUBLE AS clearance_p50 FROM fil"),
    ("response_sla", "unit_key", "count(*) FILTER (minutes_to_arrive <= 8)::DOUBLE * 100 / count(minutes_to_arrive)::DOUBLE AS response_sla FROM fil"),
    ("closed_count", "unit_key", "count(*) FILTER (closed_date_key <> -1) AS closed_count FROM fil"),
):
    bind(f"x3_{_n}", f"SELECT {_by}, {_sql} GROUP BY 1")(lambda s, d, n=_n, by=_by: semantic.bi_measure(n, T.hourly(s, d), T.incidents(s, d), T.detections(s, d), T.detections(s, d), (by,)))

from lakemart.plans import bindings_jobs  # noqa: E402, F401  (it registers the queries of whole jobs)
