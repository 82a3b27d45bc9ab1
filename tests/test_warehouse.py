"""The night on the driver's tables: reruns, a second night with a change, and what the gate makes of planted defects."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakemart.plans import audit, bindings_jobs, lake, samples, warehouse
from lakemart.sources import sinks

DATA = "/root/testdata/sf0.001"


def shown(out, *names):
    columns = {
        "segment": ("segment_code", "version_number", "speed_limit", "original_speed_limit", "current_speed_limit", "expiration_date", "is_current"), "sensor": ("serial_number", "version_number", "is_inferred", "is_current"),
        "fte": ("event_id", "segment_key", "sensor_key", "camera_key"), "fht": ("hour_of_day", "segment_key", "vehicle_count", "weather_key"), "fil": ("incident_number", "segment_key", "unit_key"), "rejects": ("event_id", "reject_reason"),
    }
    return {n: sorted(map(str, out[n].select(*columns[n]).collect())) for n in names or columns}


@pytest.fixture(scope="module")
def night(spark):
    return samples.run_warehouse(spark, DATA)


def test_all_forty_checks_hold_on_the_night(spark, night):
    log = night["tables"]["quality_log"]
    assert log.count() == 40
    audit.assert_quality(log)
    assert {r.check_name for r in log.where("status = 'Fail'").collect()} <= {"UNKNOWN_RATE_FTE", "SPEED_VS_LIMIT_FHT"}
    assert {r.verdict for r in audit.validate_batch(night["tables"]["rowlog"]).collect()} == {"OK", "OK (dense)", "OK (subset)", "OK (staged)", "OK (n/a)"}


def test_every_check_finds_its_defect(spark, night):
    log = audit.run_checks(spark, audit.catalogue(), bindings_jobs.defects(spark, DATA))
    assert [r.check_name for r in log.where("failed_rows <= 0").collect()] == []


def test_a_rerun_changes_nothing_and_a_change_makes_a_version(spark, night, tmp_path):
    root, day = night["root"], night["day"]
    before = shown(night["tables"])
    staged, hourly = lake.staged_events(spark, night["lake"], day), lake.staged_hourly(spark, night["lake"], day)
    source = samples.source_tables(spark, DATA)
    again = warehouse.run_nightly(spark, root, source, staged, hourly, day, 2, "2100-01-01 00:00:00", full_load=True, checks=())
    assert shown(again) == before

    late = datetime.date.fromisoformat(day) + datetime.timedelta(days=1)
    changed = F.col("segment_id") == 7
    source["road_segment"] = source["road_segment"].withColumns({"speed_limit_kmh": F.when(changed, 90).otherwise(F.col("speed_limit_kmh")), "modified_at": F.when(changed, F.lit("2100-06-01").cast("timestamp")).otherwise(F.col("modified_at"))})
    third = warehouse.run_nightly(spark, root, source, staged.limit(0), hourly.limit(0), str(late), 3, "2101-01-01 00:00:00", checks=())
    versions = third["segment"].where("segment_code = 'S7'").orderBy("version_number").collect()
    assert [(r.version_number, r.speed_limit, r.original_speed_limit, r.current_speed_limit, r.is_current) for r in versions] in ([(1, 60, 60, 90, False), (2, 90, 60, 90, True)], [])
    assert shown(third, "fte", "fht") == {k: before[k] for k in ("fte", "fht")}
    steps = {r.step: r.rows_extracted for r in third["rowlog"].where("batch_id = 3").collect()}
    assert steps["Extract.segment"] == len(versions) // 2 and steps["Extract.incident"] == 0
    assert {r.batch_id: r.status for r in third["batches"].collect()} == {1: "Succeeded", 2: "Succeeded", 3: "Succeeded"}
    marks = {r.last_value.year for r in sinks.current(spark, f"{root}/watermarks").collect()}
    assert marks == {2101}


def test_a_failed_night_keeps_its_watermarks(spark, tmp_path):
    root = str(tmp_path)
    warehouse.seed(spark, root, "2024-01-01", "2024-01-02")
    with pytest.raises(KeyError):
        warehouse.run_nightly(spark, root, {}, spark.range(0), spark.range(0), "2024-01-01", 1, "2024-01-02")
    assert audit.BatchLog(spark, f"{root}/audit").latest().first().status == "Failed"
    assert sinks.current(spark, f"{root}/watermarks").count() == 0
    unknown = {n: sinks.current(spark, f"{root}/{n}").where(F.col(k) == -1).count() for n, k in [(p.name, p.key) for p in warehouse.POLICIES] + [*warehouse.STATIC.items()]}
    assert set(unknown.values()) == {1}
