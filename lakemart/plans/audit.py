"""Audit as data: batch and row logs, verdicts, zone reconciliation, and the catalogue-driven quality gate."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import analytics as A
from lakemart.operators import joins
from lakemart.operators.cleanse import labelled_union

BATCH_SCHEMA = "batch_id long, pipeline string, load_date date, status string, started_at timestamp, finished_at timestamp, error string"
ROWS_SCHEMA = "batch_id long, step string, rows_extracted long, rows_inserted long, rows_updated long, rows_rejected long, logged_at timestamp"
LOG_SCHEMA = "batch_id long, check_name string, category string, severity string, target_table string, failed_rows long, status string, duration_ms long, error string, checked_at timestamp"


@dataclass
class BatchLog:
    """Batches and the rows of their steps, appended to two datasets: start, finish or fail, each one row."""

    spark: SparkSession
    path: str

    def _append(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def put(self, batch_id: int, pipeline: str, load_date: object, status: str, started: datetime, error: str | None = None) -> None:
        done = None if status == "Running" else datetime.now(timezone.utc)
        self._append("batches", (batch_id, pipeline, load_date, status, started, done, error), BATCH_SCHEMA)

    def rows(self, batch_id: int, step: str, extracted: int | None = None, inserted: int | None = None, updated: int | None = None, rejected: int | None = None) -> None:
        self._append("rows", (batch_id, step, extracted, inserted, updated, rejected, datetime.now(timezone.utc)), ROWS_SCHEMA)

    def latest(self) -> DataFrame:
        """Each batch's last state."""
        return A.latest_per_key(self.spark.read.schema(BATCH_SCHEMA).parquet(f"{self.path}/batches"), ("batch_id",), [F.desc_nulls_last("finished_at")])

    def row_log(self) -> DataFrame:
        """Each step's last counts of a batch: a step that is run again counts once."""
        return A.latest_per_key(self.spark.read.schema(ROWS_SCHEMA).parquet(f"{self.path}/rows"), ("batch_id", "step"), [F.desc("logged_at")])


#: Steps by how their counts are held against each other.
EXACT, DENSE, VERSIONED, STAGED, NONE = "exact", "dense", "versioned", "staged", "none"


def kind_of_step(step: Column) -> Column:
    """What the warehouse's steps are by their names: see validate_batch."""
    return (
        F.when(step == "Fact.TrafficEvent", EXACT).when(step == "Fact.HourlyTraffic", DENSE).when(step.rlike(r"^Dim\..*\(SCD2\)$"), VERSIONED)
        .when(step.rlike(r"^(Extract|Dim)\.") | (step == "Fact.IncidentLifecycle"), STAGED).when(step.startswith("InferredMembers") | (step == "AdvanceWatermarks"), NONE)
    )


def validate_batch(rows: DataFrame, kind: Column | None = None) -> DataFrame:
    """rows (step and counts, null being none) with a verdict and a note for each step, by its kind.

    exact: what was extracted is what was inserted, updated and rejected. dense: a spine may only add rows. versioned: new
    versions are at most the rows examined. staged: only what was read is counted. none: nothing to hold against each
    other. Any other step is exact, or counts nothing that it read.
    """
    n = {c: F.coalesce(f"rows_{c}", F.lit(0)) for c in ("extracted", "inserted", "updated", "rejected")}
    kind = kind_of_step(F.col("step")) if kind is None else kind
    whole = n["inserted"] + n["updated"] + n["rejected"]
    said = lambda holds, ok: F.when(holds, ok).otherwise("MISMATCH")
    verdict = (
        F.when(kind == EXACT, said(F.col("rows_extracted").eqNullSafe(whole), "OK")).when(kind == DENSE, said(n["inserted"] >= n["extracted"], "OK (dense)"))
        .when(kind == VERSIONED, said(n["inserted"] + n["updated"] <= n["extracted"], "OK (subset)")).when(kind == STAGED, "OK (staged)").when(kind == NONE, "OK (n/a)")
        .otherwise(said(F.col("rows_extracted").isNull() | (F.col("rows_extracted") == whole), "OK"))
    )
    text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    note = (
        F.when(kind == DENSE, text(n["inserted"] - n["extracted"], " empty rows added by the spine")).when(kind == EXACT, text(n["inserted"], " loaded, ", n["rejected"], " rejected"))
        .when((kind == VERSIONED) & (n["inserted"] + n["updated"] > 0), text(n["inserted"], " new, ", n["updated"], " versioned")).when(F.col("step").startswith("Extract."), "staged for the dimensions")
    )
    return rows.withColumns({"rows_accounted": whole, "verdict": verdict, "note": note})


def reconcile_zones(counts: dict[str, tuple[Column | DataFrame, Column | DataFrame, str]]) -> DataFrame:
    """Per check: the rows of two sides that should be equal (=) or not more than the other (<=). A side is a table, or one row with its number of rows as `n`."""
    one = lambda df, name: (df if df.columns == ["n"] else df.agg(F.count("*").alias("n"))).select(F.coalesce("n", F.lit(0)).cast("long").alias(name))
    parts = {}
    for name, (left, right, relation) in counts.items():
        both = one(left, "left_rows").crossJoin(one(right, "right_rows"))  # single rows
        holds = F.col("left_rows") == F.col("right_rows") if relation == "=" else F.col("left_rows") <= F.col("right_rows")
        parts[name] = both.withColumn("balanced", holds)
    return labelled_union(parts, "check_name")


def in_window(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Rows whose date, or yyyymmdd key, lies between two dates; a missing bound bounds nothing."""
    keyed = df.schema[column].dataType.typeName() != "date"
    for bound, holds in ((first, F.col(column).__ge__), (last, F.col(column).__le__)):
        if bound is not None:
            df = df.where(holds(F.lit(int(bound.replace("-", ""))) if keyed else F.lit(bound).cast("date")))
    return df


def execution_summary(batches: DataFrame, rows: DataFrame, log: DataFrame, tables: dict[str, DataFrame], first: str | None = None, last: str | None = None) -> DataFrame:
    """(seq, metric, value) of the batches whose load date lies in a window: batches, run time, facts, dimensions, side effects and the gate.

    tables are fte, fht, fil, segment and sensor. Values are text.
    """
    batches = in_window(batches, "load_date", first, last)
    ours = batches.select("batch_id")
    rows, log = rows.join(ours, "batch_id", "left_semi"), log.join(ours, "batch_id", "left_semi")
    number = lambda c: F.format_number(F.coalesce(c, F.lit(0)).cast("long"), 0)
    count = number(F.count("*"))
    seconds = F.coalesce(F.sum(F.unix_timestamp(F.coalesce("finished_at", "started_at")) - F.unix_timestamp("started_at")), F.lit(0))
    day = lambda f, bound: F.lit(bound) if bound else F.date_format(f("load_date"), "yyyy-MM-dd")
    tally = lambda what, *values: F.concat_ws(" / ", *[number(F.count_if(F.col(what) == v)) for v in values])
    current = lambda t, key: tables[t].where(F.col("is_current") & (F.col(key) != C.UNKNOWN_KEY))
    versions = in_window(tables["segment"].select("version_number", "effective_date").unionByName(tables["sensor"].select("version_number", "effective_date")), "effective_date", first, last)
    parts = [
        (10, "Load window", batches, F.concat_ws(" .. ", day(F.min, first), day(F.max, last))), (11, "Batches executed", batches, count), (12, "Batches succeeded / failed", batches, tally("status", "Succeeded", "Failed")),
        (13, "Total execution time", batches, F.concat(number(F.floor(seconds / 60)), F.lit(" min "), number(seconds % 60), F.lit(" s"))),
        (20, "Traffic events loaded", in_window(tables["fte"], "date_key", first, last), count), (21, "Hourly snapshot rows", in_window(tables["fht"], "date_key", first, last), count),
        (22, "Incidents tracked", in_window(tables["fil"], "detected_date_key", first, last), count), (23, "Active sensors", current("sensor", "sensor_key"), count), (24, "Active road segments", current("segment", "segment_key"), count),
        (30, "Rows rejected", rows, number(F.sum("rows_rejected"))), (31, "Inferred members created", rows.where(F.col("step").startswith("InferredMembers")), number(F.sum("rows_inserted"))),
        (32, "SCD2 versions created", versions.where("version_number > 1"), count), (40, "Quality checks passed / failed", log, tally("status", "Pass", "Fail")),
    ]
    out, *rest = [df.agg(v.alias("value")).select(F.lit(k).alias("seq"), F.lit(m).alias("metric"), "value") for k, m, df, v in parts]
    for x in rest:
        out = out.unionByName(x)
    return out


def batch_detail(batches: DataFrame, rows: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row a batch of the window: its state, run time and summed counts."""
    counts = ("rows_extracted", "rows_inserted", "rows_updated", "rows_rejected")
    sums = rows.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in counts])
    seconds = F.unix_timestamp(F.coalesce("finished_at", "started_at")) - F.unix_timestamp("started_at")
    named = in_window(batches, "load_date", first, last).select("batch_id", "pipeline", "load_date", "status", seconds.alias("duration_sec"))
    return named.join(sums, "batch_id", "left").fillna(0, [*counts])


def rejects_by_reason(rejects: DataFrame, batches: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Per reason: the rejected rows of the window's batches, and the first and last day that they say they are of."""
    ours = rejects.join(in_window(batches, "load_date", first, last).select("batch_id").distinct(), "batch_id", "left_semi")
    return ours.groupBy("reject_reason").agg(F.count("*").alias("rejected_rows"), F.min(F.to_date("event_ts")).alias("first_event_date"), F.max(F.to_date("event_ts")).alias("last_event_date"))


def stale_partitions(dataset: DataFrame, day: str, valid: DataFrame, valid_day: str) -> DataFrame:
    """Dates that a dataset has and a list of valid dates has not; unknown dates count as stale."""
    have = dataset.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("rows"))
    return have.join(valid.select(F.col(valid_day).alias("day")), "day", "left_anti")


@dataclass
class Context:
    """What checks look at: tables by name, and the load they check."""

    tables: dict[str, DataFrame]
    date_key: int = 0
    batch_id: int = 0
    today_key: int = 99991231
    more: dict[str, object] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


#: A check gives one row with failed_rows.
Check = Callable[[Context], DataFrame]


def failed(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("failed_rows"))


@dataclass(frozen=True)
class Measure:
    """What a check counts: rows of a table that meet a condition, after left joins with the keys of dimensions."""

    table: str
    condition: Column
    #: (foreign key, dimension, its key); the condition finds out by has() whether the row has that member.
    lookups: tuple[tuple[str, str, str], ...] = ()
    #: The check fails if there is no such row, in place of by each of them.
    needed: bool = False

    @property
    def failures(self) -> Column:
        n = F.count_if(self.condition)
        return (n == 0).cast("long") if self.needed else n


def has(foreign: str, dim: str) -> str:
    return f"_has_{dim}_{foreign}"


class Counted:
    """A check that is a sum of measures: the runner takes all measures of a table in one pass over it."""

    def __init__(self, measures: Callable[[Context], list[Measure]]):
        self.measures = measures

    def __call__(self, c: Context) -> DataFrame:
        out, *rest = [measured(c, m.table, [m]).select(F.col("counts")[0].alias("failed_rows")) for m in self.measures(c)]
        for x in rest:
            out = out.unionByName(x)
        return out.agg(F.sum("failed_rows").alias("failed_rows"))


def measured(c: Context, table: str, measures: Sequence[Measure]) -> DataFrame:
    """One row, `counts`: the failures of each measure, all in one pass over the table; keys that several look up are joined once."""
    rows = c[table]
    for foreign, dim, key in sorted({x for m in measures for x in m.lookups}):
        rows = rows.join(c[dim].select(F.col(key).alias(foreign), F.lit(True).alias(has(foreign, dim))).distinct(), foreign, "left")
    return rows.agg(F.array(*[m.failures for m in measures]).alias("counts"))


def _loaded(c: Context, condition: Column, only: bool) -> Column:
    return (F.col("date_key") == c.date_key) & condition if only else condition


def orphan(fact: str, dim: str, foreign: str, key: str | None = None, loaded_only: bool = False) -> Check:
    return Counted(lambda c: [Measure(fact, _loaded(c, F.col(has(foreign, dim)).isNull(), loaded_only), ((foreign, dim, key or foreign),))])


def orphan_any(fact: str, keys: Sequence[tuple[str, str, str]]) -> Check:
    """Rows that lack any of several dimensions: (foreign key, dimension, its key)."""
    lacks = lambda: F.array_contains(F.array(*[F.col(has(f, d)).isNull() for f, d, _ in keys]), True)
    return Counted(lambda c: [Measure(fact, lacks(), tuple(keys))])


def matching(table: str, condition: str | Callable[[Context], Column], loaded_only: bool = False) -> Check:
    return Counted(lambda c: [Measure(table, _loaded(c, condition(c) if callable(condition) else F.expr(condition), loaded_only))])


def repeated(table: str, *keys: str, where: str = "true") -> Check:
    return lambda c: failed(c[table].where(where).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))


def summed(*checks: Check) -> Check:
    if all(isinstance(x, Counted) for x in checks):
        return Counted(lambda c: [m for x in checks for m in x.measures(c)])

    def check(c: Context) -> DataFrame:
        out, *rest = [x(c) for x in checks]
        for x in rest:
            out = out.unionByName(x)
        return out.agg(F.sum("failed_rows").alias("failed_rows"))

    return check


def none_current(table: str, key: str) -> Check:
    return lambda c: failed(c[table].groupBy(key).agg(F.max(F.col("is_current").cast("int")).alias("any")).where("any = 0"))


def overlapping(table: str, business_key: str, key: str) -> Check:
    return lambda c: failed(joins.overlapping_intervals(c[table], business_key, key))


def empty(table: str, where: str = "true") -> Check:
    """1 if no row meets the condition."""
    return Counted(lambda c: [Measure(table, F.expr(where), needed=True)])


def milestone_order(c: Context) -> DataFrame:
    """Incidents with a reached milestone before an earlier one."""
    at = lambda m: F.when(F.col(f"{m}_date_key") != C.UNKNOWN_KEY, F.col(f"{m}_date_key").cast("long") * 1440 + F.col(f"{m}_time_key"))
    reached = F.filter(F.array(*[at(m) for m in ("detected", "dispatched", "arrived", "cleared", "closed")]), lambda x: x.isNotNull())
    rows = c["fil"].withColumn("_reached", reached)
    return failed(rows.where(F.col("_reached") != F.sort_array("_reached")))


def density(c: Context) -> DataFrame:
    """How far the day's snapshot is from 24 rows a current segment; 0 if the day wasn't fed."""
    have = c["fht"].where(F.col("date_key") == c.date_key).agg(F.count("*").alias("n"))
    want = c["segment"].where(F.col("is_current") & (F.col("segment_key") != C.UNKNOWN_KEY)).agg((F.count("*") * 24).alias("w"))
    return have.crossJoin(want).select(F.when(F.col("n") == 0, F.lit(0)).otherwise(F.abs(F.col("w") - F.col("n"))).cast("long").alias("failed_rows"))  # single rows


def phantom_days(c: Context) -> DataFrame:
    """Days of the snapshot without any vehicle and without any known weather."""
    days = c["fht"].groupBy("date_key").agg(F.sum("vehicle_count").alias("n"), F.count_if(F.col("weather_key") != C.UNKNOWN_KEY).alias("known"))
    return failed(days.where("n = 0 and known = 0"))


def staged_equals_loaded(c: Context) -> DataFrame:
    staged, loaded, bad = (failed(c[t].where(F.col("date_key") == c.date_key)).withColumnRenamed("failed_rows", t) for t in ("staged", "fte", "rejects"))
    off = F.abs(F.col("staged") - F.col("fte") - F.col("rejects"))
    return staged.crossJoin(loaded).crossJoin(bad).select(F.when(F.col("staged") == 0, F.lit(0)).otherwise(off).cast("long").alias("failed_rows"))  # single rows


def staged_hours_loaded(c: Context) -> DataFrame:
    """Staged segment-hours that are not in the snapshot under any version of their segment."""
    have = c["fht"].where(F.col("date_key") == c.date_key).select("segment_key", "hour_of_day").join(c["segment"].select("segment_key", "segment_code"), "segment_key").select("segment_code", "hour_of_day")
    return failed(c["staged_hourly"].where(F.col("date_key") == c.date_key).join(have, ["segment_code", "hour_of_day"], "left_anti"))


def missing_load_dates(c: Context) -> DataFrame:
    span = c["batches"].where("status = 'Succeeded'").agg(F.min("load_date").alias("lo"), F.max("load_date").alias("hi")).where("lo is not null")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day")).select(C.date_key(F.col("day")).alias("date_key"))
    return failed(days.join(c["fht"].select("date_key"), "date_key", "left_anti"))


def unbalanced(c: Context) -> Column:
    """The event fact's step of the batch, if it lost or gained rows."""
    whole = sum((F.coalesce(f"rows_{x}", F.lit(0)) for x in ("inserted", "updated", "rejected")), F.lit(0))
    return (F.col("batch_id") == c.batch_id) & (F.col("step") == "Fact.TrafficEvent") & (F.col("rows_extracted") != whole)


def catalogue() -> list[tuple[str, str, str, Check]]:
    """(name, category, severity, check): what the gate runs. Callers may add their own rows."""
    unknown = lambda t, k: empty(t, f"{k} = -1")
    dims = {"date": "date_key", "time": "time_key", "segment": "segment_key", "sensor": "sensor_key", "camera": "camera_key", "vehicle_type": "vehicle_type_key", "weather": "weather_key", "incident_type": "incident_type_key", "light": "light_key", "unit": "unit_key"}
    e, w = "Error", "Warning"
    orphans = [(f"ORPHAN_FTE_{n}", "Integrity", e, orphan("fte", t, k, loaded_only=True)) for n, t, k in (("DATE", "date", "date_key"), ("TIME", "time", "time_key"), ("SEGMENT", "segment", "segment_key"), ("SENSOR", "sensor", "sensor_key"), ("CAMERA", "camera", "camera_key"), ("VEHICLETYPE", "vehicle_type", "vehicle_type_key"), ("WEATHER", "weather", "weather_key"))]
    orphans += [(f"ORPHAN_FHT_{n}", "Integrity", e, orphan("fht", t, k)) for n, t, k in (("DATE", "date", "date_key"), ("SEGMENT", "segment", "segment_key"), ("WEATHER", "weather", "weather_key"))]
    return [
        *orphans,
        ("DETECTOR_ROUTING_FTE", "Integrity", e, matching("fte", "(detector_type = 'SENSOR' and camera_key <> -1) or (detector_type = 'CAMERA' and sensor_key <> -1)", True)),
        ("ORPHAN_FIL_DIMS", "Integrity", e, orphan_any("fil", [("incident_type_key", "incident_type", "incident_type_key"), ("segment_key", "segment", "segment_key"), ("unit_key", "unit", "unit_key"), ("weather_key", "weather", "weather_key")])),
        ("ORPHAN_FIL_MILESTONE_DATES", "Integrity", e, orphan_any("fil", [(f"{m}_date_key", "date", "date_key") for m in ("detected", "dispatched", "arrived", "cleared", "closed")])),
        ("DUP_BK_TYPE1_DIMS", "Uniqueness", e, summed(*[repeated(t, k) for t, k in (("vehicle_type", "type_code"), ("camera", "camera_code"), ("light", "controller_code"), ("incident_type", "type_code"), ("unit", "unit_code"))])),
        ("DUP_CURRENT_DIMROADSEGMENT", "Uniqueness", e, repeated("segment", "segment_code", where="is_current")),
        ("DUP_CURRENT_DIMSENSOR", "Uniqueness", e, repeated("sensor", "serial_number", where="is_current")),
        ("DUP_INTERSECTION_DIMTRAFFICLIGHT", "Uniqueness", e, repeated("light", "intersection_name")),
        ("DUP_FACT_TRAFFICEVENT", "Uniqueness", e, repeated("fte", "event_id")),
        ("SCD2_OVERLAP_DIMROADSEGMENT", "History", e, overlapping("segment", "segment_code", "segment_key")),
        ("SCD2_OVERLAP_DIMSENSOR", "History", e, overlapping("sensor", "serial_number", "sensor_key")),
        ("SCD2_NOCURRENT_DIMROADSEGMENT", "History", e, none_current("segment", "segment_code")),
        ("SCD2_NOCURRENT_DIMSENSOR", "History", e, none_current("sensor", "serial_number")),
        ("SCD2_INVERTED_INTERVAL", "History", e, summed(matching("segment", "effective_date > expiration_date"), matching("sensor", "effective_date > expiration_date"))),
        ("NEGATIVE_COUNTS_FHT", "Validity", e, matching("fht", "vehicle_count < 0 or heavy_vehicle_count < 0 or incident_count < 0 or heavy_vehicle_count > vehicle_count")),
        ("SPEED_RANGE_FTE", "Validity", e, matching("fte", f"speed_kmh <= 0 or speed_kmh > {C.MAX_SPEED}")),
        ("SPEED_VS_LIMIT_FHT", "Validity", w, lambda c: failed(c["fht"].select("segment_key", "avg_speed").join(c["segment"].select("segment_key", "speed_limit"), "segment_key").where("avg_speed > 1.5 * speed_limit"))),
        ("CONGESTION_RANGE_FHT", "Validity", e, matching("fht", "congestion_index < 0 or congestion_index > 1")),
        ("FUTURE_DATE_FTE", "Validity", e, matching("fte", lambda c: F.col("date_key") > c.today_key)),
        ("MILESTONE_ORDER_FIL", "Validity", e, milestone_order),
        ("NEGATIVE_LAGS_FIL", "Validity", e, matching("fil", "minutes_to_dispatch < 0 or minutes_to_arrive < 0 or minutes_to_clear < 0 or total_duration_minutes < 0")),
        ("UNKNOWN_MEMBER_MISSING", "Completeness", e, summed(*[unknown(t, k) for t, k in dims.items()])),
        ("MANDATORY_DIMS_POPULATED", "Completeness", e, summed(*[empty(t, f"{dims[t]} <> -1") for t in ("date", "time", "segment", "sensor", "vehicle_type", "weather")])),
        ("SNAPSHOT_DENSITY_FHT", "Completeness", w, density),
        ("PHANTOM_DAY_FHT", "Completeness", e, phantom_days),
        ("UNKNOWN_RATE_FTE", "Completeness", w, matching("fte", "segment_key = -1 or vehicle_type_key = -1 or weather_key = -1", True)),
        ("MISSING_LOAD_DATE", "Completeness", w, missing_load_dates),
        ("INFERRED_NEVER_COMPLETED", "Completeness", w, summed(*[matching(t, lambda c: F.col("is_inferred") & F.col("is_current") & (F.datediff(F.to_date(F.lit(str(c.today_key)), "yyyyMMdd"), "effective_date") > 7)) for t in ("segment", "sensor")])),
        ("RECON_ROWLOG_BATCH", "Reconciliation", e, matching("rowlog", unbalanced)),
        ("RECON_STG_FACT_EVENTS", "Reconciliation", e, staged_equals_loaded),
        ("RECON_STG_FACT_HOURLY", "Reconciliation", e, staged_hours_loaded),
    ]


#: The table that a check looks at, by the last part of its name.
TARGETS = {
    "FTE": "fact_event", "FHT": "fact_hourly", "FIL": "fact_incident", "DIMROADSEGMENT": "dim_segment", "DIMSENSOR": "dim_sensor", "DIMTRAFFICLIGHT": "dim_light", "TRAFFICEVENT": "fact_event",
    "EVENTS": "fact_event", "HOURLY": "fact_hourly", "BATCH": "row_log", "DATE": "batches", "INTERVAL": "dim_segment, dim_sensor", "COMPLETED": "dim_segment, dim_sensor",
}


def target_of(name: str) -> str:
    parts = name.split("_")
    return next((TARGETS[p] for p in parts if p in ("FTE", "FHT", "FIL")), None) or TARGETS.get(parts[-1], "dimensions")


def _together(frames: dict[str, Callable[[], DataFrame]]) -> dict[str, list[int]]:
    """Frames of one row, `counts`, as one job. What can't be planned is left out, and all are if the job fails."""
    rows = []
    for k, make in frames.items():
        try:
            rows.append(make().select(F.lit(k).alias("name"), "counts"))
        except Exception:  # run_checks runs the check by itself, and logs what it raises
            logging.getLogger(__name__).warning("%s can't be checked with the others", k, exc_info=True)
    out, *rest = rows or [None]
    for x in rest:
        out = out.unionByName(x)
    try:
        return {r.name: [int(n or 0) for n in r.counts] for r in out.collect()} if rows else {}  # a row a table or check
    except Exception:
        logging.getLogger(__name__).warning("quality checks are run one by one", exc_info=True)
        return {}


def fused(checks: Sequence[tuple[str, str, str, Check]], context: Context) -> dict[str, int]:
    """The failed rows of checks, by name, in two jobs: the measures of each table in one pass over it, and all else side by side.

    Checks that can't be run so are missing.
    """
    by_table: dict[str, list[tuple[str, Measure]]] = {}
    alone: dict[str, Callable[[], DataFrame]] = {}
    for name, _, _, check in checks:
        if isinstance(check, Counted):
            for m in check.measures(context):
                by_table.setdefault(m.table, []).append((name, m))
        else:
            alone[name] = lambda check=check: check(context).select(F.array(F.col("failed_rows").cast("long")).alias("counts"))
    sums = _together({t: lambda t=t, own=own: measured(context, t, [m for _, m in own]) for t, own in by_table.items()})
    out = {name: n[0] for name, n in _together(alone).items()}
    for table, own in by_table.items():
        for (name, _), n in zip(own, sums.get(table, [None] * len(own)), strict=True):
            out[name] = None if n is None or out.get(name, 0) is None else out.get(name, 0) + n
    return {k: n for k, n in out.items() if n is not None}


def run_checks(spark: SparkSession, checks: Sequence[tuple[str, str, str, Check]], context: Context) -> DataFrame:
    """The log of all checks. They are run together, and those that can't be one by one: one that fails is a failure of -1 rows, and the others go on.

    Checks that ran together have the same duration_ms, that of all of them.
    """
    began, found = time.monotonic(), {}
    if len({name for name, *_ in checks}) == len(checks):
        found = fused(checks, context)
    log, whole = [], int(1000 * (time.monotonic() - began))
    for name, category, severity, check in checks:
        began, error, rows = time.monotonic(), None, found.get(name)
        if rows is None:
            try:
                rows = int(check(context).first().failed_rows or 0)
            except Exception as e:  # what a user's check raises is logged
                rows, error = -1, str(e)[:500]
        took = whole if name in found else int(1000 * (time.monotonic() - began))
        log.append((context.batch_id, name, category, severity, target_of(name), rows, "Pass" if rows == 0 else "Fail", took, error, datetime.now(timezone.utc)))
    return spark.createDataFrame(log, LOG_SCHEMA)


def latest_results(log: DataFrame, batch_id: int | None = None) -> DataFrame:
    """The last result of each check, of one batch or of the latest that has any."""
    if batch_id is None:
        log = log.join(F.broadcast(log.agg(F.max("batch_id").alias("batch_id"))), "batch_id")  # one row
    else:
        log = log.where(F.col("batch_id") == batch_id)
    return A.latest_per_key(log, ("check_name",), [F.desc("checked_at")])


def assert_quality(log: DataFrame, batch_id: int | None = None) -> None:
    """Raise if the last result of any check of severity Error is Fail."""
    row = latest_results(log, batch_id).where("severity = 'Error' and status = 'Fail'").agg(F.count("*").alias("n"), A.listed("check_name").alias("names")).first()
    if row.n:
        raise ValueError(f"{row.n} quality checks failed: {row.names}")


def quality_summary(log: DataFrame, batch_id: int | None = None) -> DataFrame:
    """One row: how many checks ran, passed and failed by severity, and whether the gate is open."""
    fails = lambda severity: F.count_if((F.col("status") == "Fail") & (F.col("severity") == severity))
    sums = latest_results(log, batch_id).agg(
        F.max("batch_id").alias("batch_id"), F.min("checked_at").alias("run_started_at"), F.count("*").alias("checks_run"), F.count_if(F.col("status") == "Pass").alias("passed"),
        fails("Error").alias("failed_errors"), fails("Warning").alias("failed_warnings"), F.sum("duration_ms").alias("total_duration_ms"),
    )
    return sums.withColumn("gate_result", F.when(F.col("failed_errors") == 0, "PASS").otherwise("FAIL"))


def quality_report(log: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Failures first, errors before warnings."""
    return latest_results(log, batch_id).orderBy(F.col("status") != "Fail", F.when(F.col("status") == "Fail", F.col("severity") != "Error"), "category", "check_name")
