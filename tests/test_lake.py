import json
import os
import subprocess
import sys
import threading
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakemart.plans import audit, lake
from lakemart.sources import feeds, sinks

DAYS = ("2026-06-01", "2026-06-02")


def feed(folder, day, extra=()):
    tag = day.replace("-", "")
    lines = [f"{day}-{k},{day}T08:{k:02d}:00.000,SNS-{k % 2},SEG-{k % 3},NB,{'TRK' if k % 4 == 0 else 'CAR'},{50 + k}.0,2.50,40.0" for k in range(10)]
    head = "event_id,event_ts,sensor_serial,segment_code,direction,vehicle_type_code,speed_kmh,headway_seconds,occupancy_pct"
    (folder / f"sensor_readings_{tag}.csv").write_text("\n".join([head, *lines, *extra]) + "\n")
    cams = [{"event_id": f"{day}-c{k}", "camera_code": "CAM-1", "detection": {"timestamp": f"{day}T09:00:0{k}", "segment_code": "SEG-1", "direction": "SB", "vehicle_class": "BUS", "speed_kmh": 44.0, "plate_hash": "x"}} for k in range(3)]
    (folder / f"camera_events_{tag}.json").write_text(json.dumps(cams))
    obs = [{"station_code": s, "observed_at": f"{day}T08:10:00", "temperature_c": 10.0 + k, "precipitation_mm": 3.0 * k, "wind_speed_kmh": 5.0, "visibility_m": 900 + k, "condition_code": c} for k, (s, c) in enumerate((("A", "rain"), ("B", "FOG"), ("B", "FOG")))]
    (folder / f"weather_observations_{tag}.json").write_text(json.dumps(obs))


BAD = [
    "b1,2026-06-01T08:00:00.000,,SEG-1,NB,CAR,50.0,2.5,40.0", "b2,2026-06-01T08:00:00.000,SNS-1,SEG-1,NB,CAR,999.0,2.5,40.0", "b3,2026-06-01T08:00:00.000,SNS-1,SEG-1,NB,CAR,50.0,2.5,150.0",
    "b4,2027-06-01T08:00:00.000,SNS-1,SEG-1,NB,CAR,50.0,2.5,40.0", "b5,2026-05-20T08:00:00.000,SNS-1,SEG-1,NB,CAR,50.0,2.5,40.0", "b6,2026-06-01T08:00:00.000,SNS-1,SEG-1,XX,CAR,50.0,2.5,40.0",
    "2026-06-01-0,2026-06-01T08:00:00.000,SNS-0,SEG-0,NB,TRK,50.0,2.5,40.0", "not a line",
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("lake")
    raw = home / "raw"
    raw.mkdir()
    feed(raw, DAYS[0], BAD)
    feed(raw, DAYS[1])
    (raw / "_manifest.json").write_text(json.dumps([{"date": DAYS[0], "sensor_csv_rows": 18, "camera_events": 3}, {"date": DAYS[1], "sensor_csv_rows": 10, "camera_events": 3}]))
    log = audit.BatchLog(spark, f"{home}/audit")
    now = F.lit("2026-06-10").cast("timestamp")
    for k, day in enumerate(DAYS):
        lake.run_day(spark, str(raw), f"{home}/lake", day, k, now, log)
    return home, now, log


def test_every_row_is_kept_or_quarantined_with_a_reason(spark, built):
    home, _, log = built
    reasons = {r.reject_reason: r.rejected_rows for r in spark.read.parquet(f"{home}/lake/silver/quality_metrics").collect()}
    assert reasons == {x: 1 for x in ("MISSING_KEY", "SPEED_RANGE", "OCCUPANCY_RANGE", "FUTURE_TIMESTAMP", "DATE_MISMATCH", "BAD_DIRECTION", "DUPLICATE", "CORRUPT_RECORD")}
    assert {r.ingest_date: (r.rows_in, r.balanced) for r in spark.read.parquet(f"{home}/lake/silver/reconciliation").collect()} == {date(2026, 6, 1): (21, True), date(2026, 6, 2): (13, True)}
    checks = lake.reconcile(spark, f"{home}/lake", feeds.read_manifest(spark, f"{home}/raw/_manifest.json"))
    assert [r.balanced for r in checks.collect()] == [True] * 3
    assert {r.batch_id: r.status for r in log.latest().collect()} == {0: "Succeeded", 1: "Succeeded"}


def test_gold_has_the_hours_weather(spark, built):
    home, *_ = built
    r = spark.read.parquet(f"{home}/lake/gold/hourly_traffic").where("event_date = '2026-06-02' and hour_of_day = 8 and segment_code = 'SEG-0'").first()
    assert (r.vehicle_count, r.heavy_vehicle_count, r.condition_code, float(r.avg_temp_c), r.visibility_m) == (4, 1, "FOG", 10.5, 900)
    q = {r.load_date: r.asDict() for r in spark.read.parquet(f"{home}/lake/gold/quality_daily").collect()}
    assert q[date(2026, 6, 1)]["DUPLICATE"] == 1 and q[date(2026, 6, 2)]["DUPLICATE"] == 0 and q[date(2026, 6, 2)]["valid_detections"] == 13


def test_a_rerun_changes_nothing_and_removes_what_is_gone(spark, built):
    home, now, _ = built
    count = lambda: [spark.read.parquet(f"{home}/lake/{z}").count() for z in ("silver/events", "silver/quarantine", "gold/hourly_traffic", "bronze/sensor_readings")]
    before = count()
    lake.run_day(spark, str(home / "raw"), f"{home}/lake", DAYS[0], 9, now)
    assert count() == before
    feed(home / "raw", DAYS[0])
    lake.run_day(spark, str(home / "raw"), f"{home}/lake", DAYS[0], 10, now)
    assert spark.read.parquet(f"{home}/lake/silver/events").count() == 26
    left = spark.read.schema("event_id string, ingest_date date").parquet(f"{home}/lake/silver/quarantine") if any((home / "lake/silver/quarantine").glob("ingest_date=*")) else None
    assert left is None or left.count() == 0


def test_ingest_date_comes_from_the_name(spark):
    df = spark.createDataFrame([("x/sensor_readings_20260601.csv",), ("x/sensor_readings.csv",), ("x/a_20261399.csv",)], "p string")
    assert [r[0] for r in df.select(feeds.ingest_date(F.col("p"))).collect()] == [date(2026, 6, 1), None, None]


def test_watermarks(spark):
    marks = spark.sql("select 'a' table_name, timestamp '2026-01-01' last_value")
    got = feeds.advance_watermarks(feeds.advance_watermarks(marks, "a", "2026-02-01 00:00:00"), "b", "2026-03-01 00:00:00")
    assert {r.table_name: r.last_value.month for r in feeds.advance_watermarks(got, "a", None).collect()} == {"a": 2, "b": 3}
    rows = spark.sql("select explode(array(timestamp '2026-01-01', timestamp '2026-01-02', timestamp '2026-01-03')) t")
    assert feeds.incremental_extract(rows, "t", F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02").cast("timestamp")).count() == 1


def test_snapshots_are_published_beside_their_source(spark, tmp_path):
    at = f"{tmp_path}/dim"
    one = sinks.publish(spark.range(3), at, high=F.max("id"))
    old = sinks.current(spark, at)
    two = sinks.publish(old.unionByName(spark.range(3, 5)), at, after=one.number)
    assert sinks.current(spark, at).count() == 5 and old.count() == sinks.current(spark, at, 1).count() == 3
    assert (one.number, one.metrics, two.number, two.metrics) == (1, {"rows": 3, "high": 2}, 2, {"rows": 5})
    assert sinks.snapshot(spark, at) == two and sinks.snapshot(spark, at, 1) == one and sinks.snapshot(spark, f"{tmp_path}/none") is None
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, f"{tmp_path}/none")


def test_of_two_writers_one_fails_and_changes_nothing(spark, tmp_path):
    at = f"{tmp_path}/dim"
    base = sinks.publish(spark.range(1), at)
    sinks.publish(spark.range(2), at, after=base.number)
    with pytest.raises(sinks.Conflict):
        sinks.publish(spark.range(9), at, after=base.number)
    assert sinks.current(spark, at).count() == 2 and sinks.versions(spark, at) == [1, 2]
    assert len([x for x in os.listdir(at) if x.startswith("v-")]) == 2 and os.listdir(f"{at}/_drafts") == []


@pytest.mark.parametrize("step", ["write_full", "_commit", "expire"])
def test_a_writer_that_dies_leaves_a_readable_table(spark, tmp_path, monkeypatch, step):
    """Before the rows are whole, between rows and pointer, and between pointer and clearing up; the next writer goes on from there."""
    at = f"{tmp_path}/dim"
    sinks.publish(spark.range(3), at)
    whole = getattr(sinks, step)

    def dies(df, path, *rest, **more):
        if step == "write_full":
            df.limit(1).write.parquet(path)
        raise RuntimeError("killed")

    monkeypatch.setattr(sinks, step, dies)
    with pytest.raises(RuntimeError, match="killed"):
        sinks.publish(spark.range(4), at)
    assert sinks.current(spark, at).count() == (4 if step == "expire" else 3)
    monkeypatch.setattr(sinks, step, whole)
    for n in range(5, 9):
        sinks.publish(spark.range(n), at, keep=2)
        assert sinks.current(spark, at).count() == n
    assert len(sinks.versions(spark, at)) == 2 and len([x for x in os.listdir(at) if x.startswith("v-")]) == 2  # what was never named has gone as well


def test_a_draft_of_a_pointer_is_no_version(spark, tmp_path):
    at = f"{tmp_path}/dim"
    sinks.publish(spark.range(3), at)
    os.makedirs(f"{at}/_drafts", exist_ok=True)
    open(f"{at}/_drafts/v-000000000002-x", "w").close()
    assert sinks.current(spark, at).count() == 3 and sinks.publish(spark.range(4), at).number == 2


def day_files(path):
    return {d.name: sorted(d.glob("*.parquet")) for d in path.glob("event_date=*")}


def test_a_huge_day_is_dealt_to_many_tasks_and_sorted(spark, tmp_path):
    rows = spark.range(400_000).select(F.col("id"), (F.xxhash64("id") % 50).cast("string").alias("segment_code"), F.rand(3).alias("x"), F.when(F.col("id") == 7, F.lit("2026-06-02")).when(F.col("id") % 100 == 0, F.lit("2026-06-03")).otherwise(F.lit("2026-06-01")).cast("date").alias("event_date"))
    at = tmp_path / "events"
    assert sinks.write_partitioned(rows.repartition(8), str(at), "event_date", sort=("segment_code", "id"), file_bytes=1 << 20) == 400_000
    files = day_files(at)
    assert len(files["event_date=2026-06-01"]) >= 4 and len(files["event_date=2026-06-02"]) == len(files["event_date=2026-06-03"]) == 1
    for f in files["event_date=2026-06-01"]:
        got = pq.read_table(f, columns=["segment_code", "id"]).to_pylist()
        assert got == sorted(got, key=lambda r: (r["segment_code"], r["id"]))
    assert spark.read.parquet(str(at)).agg(F.sum("id")).first()[0] == 400_000 * 399_999 // 2
    assert spark.conf.get(sinks.TARGET, None) is None or spark.conf.get(sinks.TARGET) != str(1 << 20)
    # A day alone is replaced; by no row, it goes.
    assert sinks.replace_slice(rows.where("id < 1000"), str(at), "event_date", "2026-06-01") == 989
    assert sinks.replace_slice(rows.limit(0), str(at), "event_date", "2026-06-02") == 0
    assert sinks.replace_slice(rows.where("id < 0"), str(at), "event_date", "2026-06-02") == 0
    assert {k: len(v) for k, v in day_files(at).items()} == {"event_date=2026-06-01": 1, "event_date=2026-06-03": 1}


def test_a_slice_runs_its_input_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = spark.range(1000).withColumn("event_date", F.lit("2026-06-01").cast("date"))
    assert sinks.replace_slice(rows.mapInArrow(counted, rows.schema), str(tmp_path / "z"), "event_date", "2026-06-01") == 1000
    assert ran.value == 1000


RETRIED = """
import sys
sys.path.insert(0, {repo!r})
from pyspark import TaskContext
from pyspark.sql import functions as F
from lakemart.session import session
from lakemart.sources import sinks
spark = session("retry", spark__master="local[2,3]", spark__ui__enabled="false", spark__sql__shuffle__partitions="3", spark__local__dir={tmp!r}, spark__sql__warehouse__dir={tmp!r} + "/w")
spark.sparkContext.setLogLevel("OFF")
def fails_once(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
rows = spark.range(1000).withColumn("event_date", F.lit("2026-06-01").cast("date"))
wrong = rows.mapInArrow(fails_once, rows.schema)
print("ROWS", sinks.write_partitioned(wrong, {tmp!r} + "/a", "event_date"), sinks.write_full(wrong, {tmp!r} + "/b", high=F.max("id")))
"""


def test_a_repeated_task_counts_once(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", RETRIED.format(repo=repo, tmp=str(tmp_path))], capture_output=True, text=True, timeout=300)
    assert "ROWS 1000 {'rows': 1000, 'high': 999}" in out.stdout, out.stdout + out.stderr[-2000:]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    staged = sinks.to_staging(spark.range(5), {"id": "event_key"})
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for truncate in (True, True, False):
        sinks.write_jdbc(staged, url, "events", truncate, **driver)
    assert spark.read.format("jdbc").options(url=url, dbtable="events", **driver).load().count() == 10


def test_a_jdbc_slice_is_replaced_once_however_often_it_is_loaded(spark, tmp_path, monkeypatch):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    day = lambda n, d: spark.range(n).select("id", F.lit("x").alias("code"), F.lit(d).cast("date").alias("day"))
    have = lambda: {(r.day.day, r["count"]) for r in spark.read.format("jdbc").options(url=url, dbtable="facts", **driver).load().groupBy("day").count().collect()}
    sinks.write_jdbc(day(5, "2026-06-01").unionByName(day(7, "2026-06-02")), url, "facts", **driver)
    load = lambda n: sinks.replace_jdbc_slice(day(n, "2026-06-02").repartition(6).unionByName(day(3, "2026-06-01")), url, "facts", "day", date(2026, 6, 2), connections=2, **driver)
    whole = sinks.write_jdbc
    # A task that is run again after its rows were committed: the stage has them twice.
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_jdbc", lambda df, *a, **o: (whole(df, *a, **o), whole(df, *a, **(o | {"mode": "append"}))))
        assert load(9) == 9
    assert have() == {(1, 5), (2, 9)}
    # A load that fails between the deletion and the end leaves the slice as it was.
    with monkeypatch.context() as m:
        run = sinks._in_transaction
        m.setattr(sinks, "_in_transaction", lambda s, u, p, statements: run(s, u, p, [*statements, ("INSERT INTO missing_table VALUES (1)", [])]))
        with pytest.raises(Exception, match="(?i)missing_table"):
            load(2)
    assert have() == {(1, 5), (2, 9)}
    assert load(2) == load(2) == 2 and have() == {(1, 5), (2, 2)}
    assert load(0) == 0 and have() == {(1, 5)}
    with pytest.raises(ValueError, match="plain name"):
        sinks.replace_jdbc_slice(day(1, "2026-06-02"), url, "facts; drop", "day", date(2026, 6, 2), **driver)


def test_scratch_tables_belong_to_their_thread(spark):
    """Jobs of several threads at a time: none deletes what another still reads."""
    from lakemart.sources.scratch import settled, written

    wrong: list[Exception] = []

    def job(n):
        try:
            for _ in range(3):
                assert settled(spark, "threads", lambda: written(spark.range(n), "part").unionByName(written(spark.range(n), "part"))).count() == 2 * n
        except Exception as e:
            wrong.append(e)

    jobs = [threading.Thread(target=job, args=(n,)) for n in (10, 20, 30, 40)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert not wrong
