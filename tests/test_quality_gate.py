from datetime import date

import pytest
from pyspark.sql import functions as F

from lakemart.plans import audit, semantic


def context(spark):
    key = lambda k, code: spark.createDataFrame([(-1, "UNK"), (1, "A")], f"{k} int, {code} string")
    versions = lambda k, code: key(k, code).withColumns({"is_current": F.lit(True), "effective_date": F.lit("2026-01-01").cast("date"), "expiration_date": F.lit("9999-12-31").cast("date"), "is_inferred": F.lit(False), "speed_limit": F.lit(50)})
    fte = spark.createDataFrame([("e1", 20260601, 480, 1, 1, -1, 1, 1, "SENSOR", 55.0)], "event_id string, date_key int, time_key int, segment_key int, sensor_key int, camera_key int, vehicle_type_key int, weather_key int, detector_type string, speed_kmh double")
    fht = spark.range(24).select(F.lit(20260601).alias("date_key"), F.col("id").cast("int").alias("hour_of_day"), F.lit(1).alias("segment_key"), F.lit(1).alias("weather_key"), (F.col("id") == 8).cast("int").alias("vehicle_count"), F.lit(0).alias("heavy_vehicle_count"), F.lit(0).alias("incident_count"), F.lit(40.0).alias("avg_speed"), F.lit(0.2).alias("congestion_index"))
    names = ("detected", "dispatched", "arrived", "cleared", "closed")
    fil = spark.createDataFrame([(1, 1, 1, 1, *([20260601, 10] * 2), *([-1, -1] * 3), 1, None, None, None)], "incident_type_key int, segment_key int, unit_key int, weather_key int, " + ", ".join(f"{m}_date_key int, {m}_time_key int" for m in names) + ", minutes_to_dispatch int, minutes_to_arrive int, minutes_to_clear int, total_duration_minutes int")
    return audit.Context(
        {
            "fte": fte, "fht": fht, "fil": fil, "date": spark.createDataFrame([(-1,), (20260601,)], "date_key int"), "time": spark.createDataFrame([(-1,), (480,)], "time_key int"),
            "segment": versions("segment_key", "segment_code"), "sensor": versions("sensor_key", "serial_number"), "camera": key("camera_key", "camera_code"), "vehicle_type": key("vehicle_type_key", "type_code"),
            "weather": key("weather_key", "condition_code"), "incident_type": key("incident_type_key", "type_code"), "unit": key("unit_key", "unit_code"),
            "light": key("light_key", "controller_code").withColumn("intersection_name", F.col("controller_code")), "staged": spark.createDataFrame([(20260601,)], "date_key int"), "rejects": spark.createDataFrame([], "date_key int"),
            "staged_hourly": spark.createDataFrame([(20260601, "A", 8)], "date_key int, segment_code string, hour_of_day int"), "rowlog": spark.createDataFrame([(1, "Fact.TrafficEvent", 3, 2, 0, 1)], "batch_id int, step string, rows_extracted int, rows_inserted int, rows_updated int, rows_rejected int"),
            "batches": spark.createDataFrame([(date(2026, 6, 1), "Succeeded")], "load_date date, status string"),
        }, 20260601, 1, 20260601,
    )


def test_all_forty_checks_pass_on_a_sound_warehouse(spark):
    log = audit.run_checks(spark, audit.catalogue(), context(spark))
    bad = [(r.check_name, r.failed_rows, r.error) for r in log.where("status = 'Fail'").collect()]
    assert log.count() == 40 and not bad
    audit.assert_quality(log)
    assert audit.quality_report(log).count() == 40


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_the_gate_takes_two_jobs_and_gives_what_single_checks_give(spark):
    c = context(spark)
    c.tables["fte"] = c["fte"].withColumns({"segment_key": F.lit(99), "weather_key": F.lit(None).cast("int"), "speed_kmh": F.lit(300.0)}).unionByName(c["fte"])
    before = executions(spark)
    log = audit.run_checks(spark, audit.catalogue(), c)
    assert executions(spark) - before == 2
    alone = {name: int(check(c).first().failed_rows or 0) for name, _, _, check in audit.catalogue()}
    assert {r.check_name: r.failed_rows for r in log.collect()} == alone and alone["ORPHAN_FTE_WEATHER"] == 1


@pytest.mark.parametrize(
    "broken",
    [
        lambda c: c["nothing"],
        lambda c: c["fte"].selectExpr("raise_error('x') as failed_rows"),
        audit.matching("fte", "no_such_column = 1"),
        audit.matching("fte", "raise_error('x') = 1"),
        audit.orphan("fte", "segment", "no_such_key"),
    ],
)
def test_a_check_that_fails_leaves_the_others_alone(spark, broken):
    c = context(spark)
    log = audit.run_checks(spark, [*audit.catalogue()[:14], ("BROKEN", "Own", "Error", broken), ("OWN", "Own", "Error", audit.matching("fht", "hour_of_day > 20"))], c)
    assert {r.check_name: r.failed_rows for r in log.where("failed_rows <> 0").collect()} == {"BROKEN": -1, "OWN": 3}


def test_failures_are_found_and_errors_block(spark):
    c = context(spark)
    c.tables["fte"] = c["fte"].withColumns({"segment_key": F.lit(99), "speed_kmh": F.lit(300.0), "camera_key": F.lit(1)}).unionByName(c["fte"])
    c.tables["segment"] = c["segment"].unionByName(c["segment"].where("segment_key = 1").withColumn("segment_key", F.lit(2)))
    wanted = {"ORPHAN_FTE_SEGMENT", "SPEED_RANGE_FTE", "DETECTOR_ROUTING_FTE", "DUP_FACT_TRAFFICEVENT", "DUP_CURRENT_DIMROADSEGMENT", "SCD2_OVERLAP_DIMROADSEGMENT", "SNAPSHOT_DENSITY_FHT", "RECON_STG_FACT_EVENTS"}
    log = audit.run_checks(spark, [*audit.catalogue(), ("BROKEN", "Own", "Error", lambda c: c["nothing"])], c)
    assert {r.check_name for r in log.where("status = 'Fail'").collect()} == wanted | {"BROKEN"}
    assert log.where("check_name = 'BROKEN'").first().failed_rows == -1
    with pytest.raises(ValueError, match="SPEED_RANGE_FTE"):
        audit.assert_quality(log)
    warning = log.where("check_name = 'SNAPSHOT_DENSITY_FHT'")
    audit.assert_quality(warning)


def test_verdicts(spark):
    steps = {
        ("Fact.TrafficEvent", 5, 4, 0, 1): ("OK", "4 loaded, 1 rejected"), ("Fact.TrafficEvent", 100, 60, 0, None): ("MISMATCH", "60 loaded, 0 rejected"), ("Fact.TrafficEvent", None, 1, None, None): ("MISMATCH", "1 loaded, 0 rejected"),
        ("Fact.HourlyTraffic", 5, 9, None, None): ("OK (dense)", "4 empty rows added by the spine"), ("Fact.HourlyTraffic", 5, 3, 0, 0): ("MISMATCH", "-2 empty rows added by the spine"),
        ("Dim.segment (SCD2)", 5, 1, 1, None): ("OK (subset)", "1 new, 1 versioned"), ("Dim.segment (SCD2)", 1, 1, 1, None): ("MISMATCH", "1 new, 1 versioned"), ("Dim.camera", 5, 1, 0, None): ("OK (staged)", None),
        ("Extract.sensor", 5, None, None, None): ("OK (staged)", "staged for the dimensions"), ("Fact.IncidentLifecycle", 5, None, None, None): ("OK (staged)", None), ("InferredMembers.sensor", None, 7, None, None): ("OK (n/a)", None),
        ("AdvanceWatermarks", None, None, 8, None): ("OK (n/a)", None), ("Other", 3, 2, 1, None): ("OK", None), ("Other", 3, 2, 0, None): ("MISMATCH", None), ("Other", None, 2, 0, None): ("OK", None),
    }
    rows = spark.createDataFrame([*steps], "step string, rows_extracted int, rows_inserted int, rows_updated int, rows_rejected int")
    got = {tuple(r)[:5]: (r.verdict, r.note) for r in audit.validate_batch(rows).collect()}
    assert got == steps


def test_the_last_batch_decides(spark):
    c = context(spark)
    one = audit.run_checks(spark, [("SPEED_RANGE_FTE", "Validity", "Error", lambda c: c["fte"].selectExpr("1 as failed_rows"))], c)
    c.batch_id = 2
    two = audit.run_checks(spark, [("SPEED_RANGE_FTE", "Validity", "Error", lambda c: c["fte"].selectExpr("0 as failed_rows"))], c)
    log = one.unionByName(two)
    audit.assert_quality(log)
    with pytest.raises(ValueError):
        audit.assert_quality(log, 1)
    assert audit.quality_summary(log).first().gate_result == "PASS" and audit.quality_summary(log, 1).first().failed_errors == 1
    assert log.first().target_table == "fact_event"


def test_rules_that_never_fired_are_armed(spark):
    rejects = spark.createDataFrame([("A", None, "S1")], "reject_reason string, event_ts timestamp, sensor_serial string")
    reasons = spark.createDataFrame([("A",), ("B",)], "reject_reason string")
    assert {r.reject_reason: r.status for r in semantic.rules_fired(rejects, reasons).collect()} == {"A": "FIRED", "B": "ARMED"}
    assert semantic.bi_reject_daily(rejects).first().date_key == -1
