from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import cleanse

BASE = {
    "event_id": "E1", "event_ts": datetime(2026, 6, 1, 8, 30), "detector_type": "SENSOR", "detector_code": "SNS-0001", "sensor_serial": "SNS-0001", "camera_code": None,
    "segment_code": "SEG-001", "direction": "NB", "vehicle_type_code": "CAR", "speed_kmh": Decimal("55.0"), "headway_seconds": Decimal("2.50"), "occupancy_pct": Decimal("42.0"),
    "_ingest_ts": datetime(2026, 6, 2), "_source_file": "a.csv", "event_date": date(2026, 6, 1), "ingest_date": date(2026, 6, 1),
}
SCHEMA = ", ".join(f"{c} {t}" for c, t in cleanse.EVENT_COLUMNS.items())


def rows(spark, *overrides):
    return spark.createDataFrame([tuple((BASE | o).values()) for o in overrides], SCHEMA)


LATER = datetime(2026, 6, 3)
#: What breaks each rule, in the rules' order, from just beyond its bound to far away; and what just keeps it.
BREAKS = {
    "MISSING_KEY": [{c: None} for c in ("event_id", "detector_code", "event_ts")], "SPEED_RANGE": [{"speed_kmh": Decimal(x)} for x in ("0.0", "-0.1", "250.1", "700")], "OCCUPANCY_RANGE": [{"occupancy_pct": Decimal(x)} for x in ("-0.01", "100.01")],
    "FUTURE_TIMESTAMP": [{"event_ts": LATER + timedelta(seconds=s)} for s in (1, 10**7)], "DATE_MISMATCH": [{"event_date": BASE["event_date"] + timedelta(days=k)} for k in (-1, 1, 40)], "BAD_DIRECTION": [{"direction": x} for x in ("N", "nb", "")],
    "UNKNOWN_INGEST_DATE": [{"ingest_date": None}],
}
KEEPS = [{"speed_kmh": Decimal(x)} for x in ("0.1", "250.0")] + [{"occupancy_pct": Decimal(x)} for x in (0, 100)] + [{"event_ts": LATER}, *({"direction": d} for d in C.DIRECTIONS)] + [{c: None} for c in ("speed_kmh", "occupancy_pct", "direction", "segment_code")]
CASES = [(o, None) for o in KEEPS] + [(o, reason) for reason, os in BREAKS.items() for o in os]
#: Of two broken rules the first counts; without an ingest date no event date differs from it.
CASES += [(a | b, first) for k, (first, (a, *_)) in enumerate(BREAKS.items()) for b, *_ in list(BREAKS.values())[k + 1 :] if "event_date" not in a or "ingest_date" not in b]


def test_first_failing_rule_is_the_reason(spark):
    df = rows(spark, *[o | {"_source_file": str(k)} for k, (o, _) in enumerate(CASES)])
    rules = [*C.event_rules(F.lit(LATER)), C.unknown_ingest_date()]
    got = {int(r._source_file): r.reject_reason for r in cleanse.apply_rules(df, rules).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_duplicates_keep_the_first_by_file_and_override_reasons(spark):
    df = cleanse.apply_rules(rows(spark, {"_source_file": "b.csv", "speed_kmh": Decimal(999)}, {}), C.boundary_rules())
    got = {r._source_file: r.reject_reason for r in cleanse.label_duplicates(df, ("event_id",), cleanse.event_order()).collect()}
    assert got == {"a.csv": None, "b.csv": "DUPLICATE"}


def test_rows_without_an_id_are_one_group(spark):
    df = cleanse.apply_rules(rows(spark, {"event_id": None}, {"event_id": None, "_source_file": "b.csv"}), C.boundary_rules())
    assert sorted(r.reject_reason for r in cleanse.label_duplicates(df, ("event_id",), cleanse.event_order()).collect()) == ["DUPLICATE", "MISSING_KEY"]


def test_reconcile_and_reject_rows(spark):
    df = cleanse.apply_rules(rows(spark, {}, {"event_id": "E2", "direction": "XX"}), C.event_rules(F.lit(LATER)))
    r = cleanse.reconcile(df).first()
    assert (r.rows_in, r.rows_good, r.rows_quarantined, r.balanced) == (2, 1, 1, True)
    assert [x.payload for x in cleanse.build_rejects(df, 1, ("event_id", "camera_code", "direction")).collect()] == ["E2||XX"]


@pytest.mark.parametrize(
    "function, edges, names, step, missing",
    [(C.band_temperature, C.TEMPERATURE_EDGES, C.TEMPERATURE_NAMES, 0.5, "Unknown"), (C.band_precipitation, C.PRECIPITATION_EDGES, C.PRECIPITATION_NAMES, 0.25, "None"), (C.band_visibility, C.VISIBILITY_EDGES, C.VISIBILITY_NAMES, 1, "Good")],
)
def test_bands_hold_their_lower_edge(spark, function, edges, names, step, missing):
    """A value at an edge is in the band above it, one just below in the band below; a null has a name of its own."""
    cases = [(None, missing)] + [x for e, below, above in zip(edges, names, names[1:], strict=False) for x in ((e - step, below), (e, above), (e + step, above))]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, (v, _) in enumerate(cases)], "k int, v double")
    got = {r.k: r.band for r in df.select("k", function(F.col("v")).alias("band")).collect()}
    assert got == {k: name for k, (_, name) in enumerate(cases)}


def test_no_rain_is_no_band(spark):
    assert [r[0] for r in spark.sql("select explode(array(0D, 0.01D)) v").select(C.band_precipitation(F.col("v"))).collect()] == ["None", "Light"]


def test_measures(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    r = spark.range(1).select(
        C.minute_lag(ts("2026-01-01 08:00:59"), ts("2026-01-01 08:01:00")).alias("lag"), C.date_key(ts("2026-01-02 03:04:05")).alias("d"), C.time_key(ts("2026-01-02 03:04:05")).alias("t"),
        C.date_key(F.lit(None).cast("timestamp")).alias("none"), C.congestion_index(F.lit(30), F.lit(40)).alias("c"), C.congestion_index(F.lit(90), F.lit(40)).alias("free"), C.congestion_index(F.lit(30), F.lit(0)).alias("no"),
        C.normalized(F.lit(" n/a ")).alias("gone"), C.normalized(F.lit(" ab ")).alias("kept"),
    ).first()
    assert (r.lag, r.d, r.t, r.none, r.c, r.free, r.no, r.gone, r.kept) == (1, 20260102, 184, -1, Decimal("0.250"), Decimal("0.000"), None, None, "AB")


def test_hash_tells_null_from_a_missing_column(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "~", "b")], "x string, y string, z string")
    assert df.select(C.hash_diff(("x", "y", "z"))).distinct().count() == 3
