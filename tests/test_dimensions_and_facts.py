import random
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakemart.operators import analytics, dimensions, facts, joins, spines
from lakemart.plans import history
from lakemart.sources import sinks
from lakemart.sources.scratch import written

T2 = ("road_name", "speed_limit")
OPTIONS = {"type0": {"original_limit": "speed_limit"}, "type6": {"current_limit": "speed_limit"}}


def source(spark, *rows):
    return spark.createDataFrame(list(rows), "segment_code string, road_name string, speed_limit int")


@pytest.fixture(scope="module")
def day1(spark):
    more = {"original_limit": F.col("speed_limit"), "current_limit": F.col("speed_limit")}
    return dimensions.first_versions(source(spark, ("SEG-001", "A", 50), ("SEG-002", "B", 60)), "segment_code", "segment_key", T2, "2026-06-01", more).persist()


def merge(dim, src, day):
    return dimensions.scd2_merge(dim, src, "segment_code", "segment_key", T2, day, **OPTIONS)


def seen(dim, *columns):
    return sorted(tuple(r) for r in dim.select(*columns).collect())


def test_a_change_makes_a_version_and_a_rerun_makes_none(spark, day1):
    src = source(spark, ("SEG-001", "A", 60), ("SEG-003", "C", 70))
    day2 = merge(day1, src, "2026-06-02")
    show = ("segment_code", "version_number", "speed_limit", "original_limit", "current_limit", "is_current", "effective_date", "expiration_date")
    want = [
        ("SEG-001", 1, 50, 50, 60, False, date(2026, 6, 1), date(2026, 6, 1)), ("SEG-001", 2, 60, 50, 60, True, date(2026, 6, 2), date(9999, 12, 31)),
        ("SEG-002", 1, 60, 60, 60, True, date(2026, 6, 1), date(9999, 12, 31)), ("SEG-003", 1, 70, 70, 70, True, date(2026, 6, 2), date(9999, 12, 31)),
    ]
    assert seen(day2, *show) == want
    assert seen(merge(day2, src, "2026-06-02"), *show) == want
    keys = [r.segment_key for r in day2.collect()]
    assert len(set(keys)) == 4 and None not in keys


def test_a_split_history_is_the_whole_one_and_writes_no_closed_version_twice(spark, tmp_path):
    at, whole = f"{tmp_path}/segment", dimensions.first_versions(source(spark, *[(f"S{k:03d}", "A", 50) for k in range(100)]), "segment_code", "segment_key", T2, "2026-06-01", {"original_limit": F.col("speed_limit"), "current_limit": F.col("speed_limit")})
    history.begin(whole, at)
    show = ("segment_code", "segment_key", "version_number", "speed_limit", "original_limit", "current_limit", "is_current", "effective_date", "expiration_date")
    nights = [("02", 1, 60), ("03", 3, 70), ("03", 3, 70), ("03", 3, 75), ("04", 1, 80), ("05", 200, 90)]  # a change, one of others, a rerun, a correction, a second version, a new member
    written_once, whole = {}, written(whole, "whole")
    for day, k, limit in nights:
        src = source(spark, (f"S{k:03d}", "A", limit))
        whole = written(merge(whole, src, f"2026-06-{day}"), "whole")
        told = history.load(src, at, "segment_code", "segment_key", T2, f"2026-06-{day}", type0=OPTIONS["type0"], parts=3)
        got = history.all_versions(spark, at, "segment_code", OPTIONS["type6"])
        assert seen(got, *show) == seen(whole, *show)
        assert told.metrics["closed"] <= 3 and told.metrics["current"] == whole.where("is_current").count()
        files = {str(f): f.stat().st_mtime_ns for c in told.carried for f in Path(c.removeprefix("file:")).glob("*.parquet")}
        assert all(written_once.get(f, t) == t for f, t in files.items())
        written_once |= files
    first = history.all_versions(spark, at, "segment_code", OPTIONS["type6"], 1)
    assert first.count() == 100  # readers of the first version still have it
    for _ in range(12):  # versions go, and what later ones carry stays
        told = history.load(src, at, "segment_code", "segment_key", T2, "2026-06-05", type0=OPTIONS["type0"], parts=30)
    assert len(sinks.versions(spark, at)) == sinks.KEEP and seen(history.all_versions(spark, at, "segment_code", OPTIONS["type6"]), *show) == seen(whole, *show)
    with pytest.raises(sinks.Conflict):
        sinks.publish_parts({"current": whole.limit(1)}, at, told.number - 1)
    assert history.current_versions(spark, at).count() == 101


def test_a_second_change_on_the_same_day_is_corrected_in_place(spark, day1):
    once = merge(day1, source(spark, ("SEG-001", "A", 60)), "2026-06-02")
    twice = merge(once, source(spark, ("SEG-001", "A", 80)), "2026-06-02")
    assert seen(twice.where("segment_code = 'SEG-001'"), "version_number", "speed_limit", "current_limit", "original_limit") == [(1, 50, 80, 50), (2, 80, 80, 50)]


def test_inferred_members_are_completed_in_place(spark, day1):
    late = spark.createDataFrame([("SEG-009",), ("SEG-001",), (None,)], "segment_code string")
    dim = dimensions.infer_members(late, day1, "segment_code", "segment_key", {"road_name": "UNKNOWN"}, "2026-06-02")
    assert seen(dim.where("is_inferred"), "segment_code", "road_name", "version_number") == [("SEG-009", "UNKNOWN", 1)]
    done = merge(dim, source(spark, ("SEG-009", "Z", 90)), "2026-06-05").where("segment_code = 'SEG-009'")
    assert seen(done, "version_number", "road_name", "is_inferred", "original_limit", "effective_date") == [(1, "Z", False, 90, date(2026, 6, 2))]


def test_facts_find_the_version_of_their_day(spark, day1):
    dim = merge(day1, source(spark, ("SEG-001", "A", 60)), "2026-06-02")
    fact = spark.createDataFrame([(1, "SEG-001", date(2026, 6, 1)), (2, "SEG-001", date(2026, 6, 2)), (3, "SEG-404", date(2026, 6, 2))], "id int, segment_code string, day date")
    got = joins.pit_join(fact, dim, {"segment_code": "segment_code"}, "day")
    assert seen(got.withColumn("v", F.coalesce("version_number", F.lit(0))), "id", "v") == [(1, 1), (2, 2), (3, 0)]


def test_event_fact_keys(spark, day1):
    ev = spark.createDataFrame(
        [("e1", datetime(2026, 6, 1, 8), date(2026, 6, 1), "SENSOR", "SEG-001", "S1", None, "CAR", Decimal("55.0"), "RAIN", 10.0, 3.0, 900), ("e2", datetime(2026, 6, 1, 9), date(2026, 6, 1), "CAMERA", "NO", None, "C1", "??", Decimal("40.0"), None, None, None, None)],
        "event_id string, event_ts timestamp, event_date date, detector_type string, segment_code string, sensor_serial string, camera_code string, vehicle_type_code string, speed_kmh decimal(5,1), condition_code string, avg_temp_c double, precipitation_mm double, visibility_m int",
    ).withColumns({"headway_seconds": F.lit(None).cast("decimal(6,2)"), "occupancy_pct": F.lit(None).cast("decimal(5,2)")})
    sensors = spark.createDataFrame([(7, "S1", date(2026, 1, 1), date(9999, 12, 31))], "sensor_key int, serial_number string, effective_date date, expiration_date date")
    vehicles = spark.createDataFrame([(3, "CAR")], "vehicle_type_key int, type_code string")
    cameras = spark.createDataFrame([(4, "C1")], "camera_key int, camera_code string")
    weather = spines.build_dim_weather(spark).withColumn("weather_key", F.lit(5))
    got = facts.load_fact_event(ev, day1, sensors, vehicles, weather, cameras).orderBy("event_id").collect()
    a, b = got
    assert (a.date_key, a.time_key, a.sensor_key, a.camera_key, a.vehicle_type_key, a.weather_key, a.speed_over_limit_kmh) == (20260601, 480, 7, -1, 3, 5, Decimal("5.0"))
    assert (b.segment_key, b.sensor_key, b.camera_key, b.vehicle_type_key, b.weather_key, b.speed_over_limit_kmh) == (-1, -1, 4, -1, -1, None)


def test_hourly_snapshot_is_dense_and_skips_a_day_without_rows(spark, day1):
    measured = spark.createDataFrame([(20260601, 8, "SEG-001", 1, 5, 1, Decimal("30.0"))], "date_key int, hour_of_day int, segment_code string, segment_key int, vehicle_count long, heavy_vehicle_count long, avg_speed decimal(7,1)")
    key = day1.where("segment_code = 'SEG-001'").first().segment_key
    inc = spark.createDataFrame([(20260601, key, 8), (20260601, key, 8)], "date_key int, segment_key int, hour_of_day int")
    members = spines.build_dim_weather(spark).withColumn("weather_key", F.lit(5))
    measured = measured.withColumns({"condition_code": F.lit("RAIN"), "avg_temp_c": F.lit(3.0), "precipitation_mm": F.lit(8.0), "visibility_m": F.lit(100)})
    got = facts.hourly_snapshot(measured, day1, members, inc, 20260601)
    assert got.count() == 48 and got.agg(F.sum("vehicle_count")).first()[0] == 5
    r = got.where("vehicle_count = 5").first()
    assert (r.incident_count, r.congestion_index, r.weather_key, r.precipitation_mm) == (2, Decimal("0.400"), 5, 8.0)
    assert [x.weather_key for x in got.where("vehicle_count = 0").select("weather_key").distinct().collect()] == [-1]
    assert facts.hourly_snapshot(measured, day1, members, inc, 20260602).count() == 0


def test_scd1_and_scd3(spark):
    dim = spark.createDataFrame([(1, "L1", "A", None, None, "x")], "light_key int, code string, plan string, previous_plan string, plan_changed date, status string")
    src = spark.createDataFrame([("L1", "B", "y"), ("L2", "A", "z")], "code string, plan string, status string")
    got = dimensions.scd3_merge(dim, src, "code", "plan", ("status",), "light_key", "2026-06-02")
    assert seen(got.withColumn("p", F.coalesce("previous_plan", F.lit("-"))), "light_key", "code", "plan", "p", "status") == [(1, "L1", "B", "A", "y"), (2, "L2", "A", "-", "z")]
    again = dimensions.scd3_merge(got, src, "code", "plan", ("status",), "light_key", "2026-06-09")
    assert again.where("code = 'L1'").first().plan_changed == date(2026, 6, 2)
    assert seen(dimensions.scd1_merge(dim.select("light_key", "code", "status"), src, "code", ("status",), "light_key"), "light_key", "code", "status") == [(1, "L1", "y"), (2, "L2", "z")]


def test_types_4_and_5(spark, day1):
    mini = dimensions.mini_dimension(day1, ("speed_limit",), "mini_key")
    assert mini.count() == 2
    assert dimensions.outrigger(day1, mini, ("speed_limit",), "mini_key").where("mini_key = -1").count() == 0


def test_members(spark):
    assert spines.build_dim_weather(spark).count() == 366 and spines.build_dim_time(spark).count() == 1440 and spines.build_dim_date(spark).count() == 3653
    rush = spines.build_dim_time(spark).where("is_rush_hour = 1")
    assert rush.count() == 120 + 150
    assert spines.with_unknown_member(spines.build_dim_weather(spark).withColumn("weather_key", F.lit(1)), "weather_key", {"condition_code": "UNK"}).where("weather_key = -1").count() == 1


def test_weighted_rollup(spark):
    df = spark.createDataFrame([("Dry", 194122, 45.0), ("Rain", 70164, 36.7), ("Rain", 17125, 41.2), ("Rain", 7436, 33.0), ("None", 0, 9.0)], "name string, n long, speed double")
    got = {r.name: (r.total, r.speed) for r in analytics.weighted_avg(df, ("name",), {"speed": "speed"}, "n", "total").collect()}
    assert got["Rain"][0] == 94725 and round(got["Rain"][1], 1) == 37.2 and round(got["Dry"][1], 1) == 45.0 and got["None"][1] is None


def test_no_gap_is_told(spark):
    days = spark.createDataFrame([(date(2026, 6, 1),), (date(2026, 6, 2),)], "day date")
    assert [r.verdict for r in spines.date_gaps(days, "day", days, "day").collect()] == ["NO GAPS"]


def test_numbers_are_consecutive_over_ranges(spark):
    from lakemart.operators.numbering import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = numbered(df, ("k",), "n", 5)
    assert [(r.k, r.n) for r in got.orderBy("k").collect()] == [(k, k + 6) for k in range(1000)]
    assert numbered(df.limit(0), ("k",), "n").count() == 0


def test_quantile_buckets_and_top_percent(spark):
    for rows, n in ((10, 4), (3, 5), (12, 4), (0, 3)):
        got = analytics.quantile_bucket(spark.range(rows), [F.col("id")], n)
        sizes = [r["count"] for r in got.groupBy("bucket").count().orderBy("bucket").collect()]
        assert sizes == [len(range(k, rows, n)) for k in range(n) if k < rows]
    assert [r.id for r in analytics.top_percent(spark.range(41), [F.desc("id")], 5).orderBy("id").collect()] == [38, 39, 40]


def test_rows_without_a_key_are_one_group(spark):
    from lakemart.operators import cleanse

    rows = [(None, k, None) for k in range(300)] + [("a", 1, None), ("a", 2, "X"), ("b", 0, None)]
    got = cleanse.label_duplicates(spark.createDataFrame(rows, "event_id string, t int, reject_reason string").repartition(5), ("event_id",), [F.col("t")])
    assert [(r.event_id, r.t) for r in got.where("reject_reason is distinct from 'DUPLICATE'").orderBy("event_id", "t").collect()] == [(None, 0), ("a", 1), ("b", 0)]
    assert got.count() == 303


def test_asof_joins_match_brute_force(spark):
    rnd = random.Random(3)
    left = [(k, rnd.choice(("a", "b", None)), rnd.choice((None, *range(100)))) for k in range(400)]
    right = [(rnd.choice(("a", "b", "c", None)), rnd.choice((None, *range(0, 120, 3))), rnd.choice(("s1", "s2", "s3", None))) for _ in range(150)]
    ts = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c)))
    lefts, rights = ts(spark.createDataFrame(left, "id int, k string, t int"), "t"), ts(spark.createDataFrame(right, "k string, u int, s string"), "u")

    def best(k, t, keyed):
        met = [(u, s) for j, u, s in right if t is not None and u is not None and u <= t and (not keyed or j == k is not None or (j is not None and j == k))]
        if not met or (keyed and k is None):
            return None
        last = max(u for u, _ in met)
        return min((s for u, s in met if u == last), key=lambda s: (s is None, s))

    keyed = joins.asof_join(lefts, rights, "t", "u", ("k",), ("s",), ("s",))
    assert {r.id: r.right_s for r in keyed.collect()} == {i: best(k, t, True) for i, k, t in left}
    for crowded in (None, 0, 40):  # all keys by one task each, all in ranges, and some
        cut = joins.asof_join(lefts, rights, "t", "u", ("k",), ("s",), ("s",), crowded)
        assert {r.id: r.right_s for r in cut.collect()} == {i: best(k, t, True) for i, k, t in left}
    for buckets in (1, 7, 200):
        free = joins.asof_join_unkeyed(lefts, rights, "t", "u", ("s",), ("s",), buckets)
        assert {r.id: r.right_s for r in free.collect()} == {i: best(k, t, False) for i, k, t in left}
    assert {r.right_s for r in joins.asof_join_unkeyed(lefts, rights.limit(0), "t", "u", ("s",), ("s",)).collect()} == {None}


def test_a_busy_key_of_an_asof_join_is_many_tasks_work(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("t"), "id")
    rights = rows.where("id % 50000 = 7")  # few, so that ranges without any carry one on
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # or so few rows would be one range
    try:
        kept = joins.asof_join(rows.repartition(8), rights, "t", "t", ("k",), ("id",), ("id",), crowded=50_000)
        assert kept.count() == 200_000
        assert kept.where("not right_id <=> if(id < 7, null, id - (id - 7) % 50000)").count() == 0
        tasks = kept.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and max(r["count"] for r in tasks) < 200_000
    finally:
        spark.conf.unset(merge)


def test_overlaps_by_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(("a", "b", "c", None)), rnd.randrange(60), rnd.choice((None, *range(1, 40))), rnd.choice((None, *range(1, 40)))) for _ in range(240)]
    rows += rows[:30]
    dim = spark.createDataFrame(rows, "b string, k int, e int, x int")
    want = sorted((r[0], r[1], s[1]) for r in rows for s in rows if None not in (*r, *s) and r[0] == s[0] and r[1] < s[1] and r[2] <= s[3] and s[2] <= r[3])
    assert seen(joins.overlapping_intervals(dim, "b", "k", "e", "x"), "b", "first_key", "second_key") == want and want
    assert joins.overlapping_intervals(dim.limit(0), "b", "k", "e", "x").count() == 0


def test_many_versions_that_keep_apart_make_no_pair(spark):
    """100,000 versions of one key, one after the other, and one that is open over the last ten."""
    days = lambda c: F.date_add(F.lit("1000-01-01").cast("date"), c.cast("int"))
    dim = spark.range(100_000).select(F.lit("a").alias("b"), F.col("id").alias("k"), days(F.col("id") * 2).alias("e"), days(F.col("id") * 2 + 1).alias("x"))
    assert joins.overlapping_intervals(dim, "b", "k", "e", "x").count() == 0
    late = spark.range(1).select(F.lit("a").alias("b"), F.lit(-1).cast("long").alias("k"), days(F.lit(2 * 99_990)).alias("e"), days(F.lit(400_000)).alias("x"))
    assert joins.overlapping_intervals(dim.unionByName(late), "b", "k", "e", "x").count() == 10


def test_routes_by_brute_force(spark):
    rnd = random.Random(3)
    graph = {(a, b): rnd.randrange(1, 9) for a in range(12) for b in rnd.sample(range(12), 4) if a != b}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in graph.items()], "src int, dst int, length int")
    found, here = [], [((0,), 0)]
    for _ in range(5):
        here = [((*p, b), n + m) for p, n in here if len(p) == 1 or p[-1] != 7 for (a, b), m in graph.items() if a == p[-1] and b not in p]
        found += [(n, len(p) - 1, ">".join(map(str, p))) for p, n in here if p[-1] == 7]
    for k, beam in ((4, 1), (4, 1000), (10_000, 1000)):
        got = [(r.length, r.hops, r.route) for r in spines.routes(edges, 0, 7, 5, k, beam).collect()]
        assert got == sorted(found)[:k]
    assert spines.routes(edges, 0, 99, 5, 3).count() == 0


def test_routes_of_a_great_graph_follow_what_can_still_arrive(spark):
    """100,000 edges, twenty from each node: of 20^5 paths, those near the shortest are followed."""
    nodes = 5000
    edges = spark.range(nodes * 20).select((F.col("id") % nodes).alias("src"), (F.xxhash64("id") % nodes + nodes).alias("d"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)) + 10).alias("length")).select("src", F.pmod("d", F.lit(nodes)).alias("dst"), "length")
    edges = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("length").alias("length"))
    got = spines.routes(edges, 1, 2, 6, 5).collect()
    assert len(got) == 5 and all(r.route.startswith("1>") and r.route.endswith(">2") and r.hops <= 6 for r in got)


def test_hours_are_merged_as_masks(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("a", 23), ("b", 5), ("b", None), ("c", None), ("c", 24), ("c", -1)], "k string, h int")
    loads = [rows.where(c).groupBy("k").agg(analytics.hours_seen(F.col("h")).alias("m")) for c in ("h = 0", "h is null or h <> 0")]
    both = loads[0].unionByName(loads[1]).groupBy("k").agg(analytics.hours_in(analytics.all_hours("m")).alias("n"))
    assert seen(both, "k", "n") == [("a", 2), ("b", 1), ("c", 0)]


def test_quantiles_come_from_merged_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 24).alias("h"), F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 1000 == 1, F.lit("few")).otherwise(F.lit("b")).alias("k"), F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(9973))).alias("x"))
    rows = rows.unionByName(spark.range(5).select(F.lit(1).cast("long").alias("h"), F.lit("none").alias("k"), F.lit(None).cast("long").alias("x")))
    hours = rows.groupBy("k", "h").agg(analytics.sketched("x").alias("s"))
    found = analytics.quantile_of_sketches(hours, ("k",), "s", {"p50": 0.5, "p85": 0.85})
    for name, p in (("p50", 0.5), ("p85", 0.85)):
        assert {r.k: r.within for r in analytics.sketch_holds(rows, ("k",), "x", found, name, p).collect()} == {"a": True, "b": True, "few": True}
    assert [r.within for r in analytics.sketch_holds(rows, ("k",), "x", found.withColumn("p85", F.lit(100.0)), "p85", 0.85).collect()] == [False] * 3


def test_reachable_edges_repeat_none_on_a_path(spark):
    edges = spark.createDataFrame([("ab", 1, 2), ("bc", 2, 3), ("ca", 3, 1), ("bd", 2, 4)], "edge string, src int, dst int")
    got = sorted((r.hop, r.edge, ">".join(r.path)) for r in spines.reachable(edges, 1, 5).collect())
    assert got == [(1, "ab", "ab"), (2, "bc", "ab>bc"), (2, "bd", "ab>bd"), (3, "ca", "ab>bc>ca")]


def test_weather_members_are_made_in_few_partitions(spark):
    from lakemart.operators import spines

    members = spines.build_dim_weather(spark)
    assert members.rdd.getNumPartitions() <= 2 and members.count() == members.distinct().count()
