"""The warehouse's nightly run over DataFrames: extracts with one bound, dimensions before facts, incidents before the hourly snapshot, checks, watermarks last."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions import columns as C
from lakemart.operators import cleanse, dimensions, facts, spines
from lakemart.plans import audit, extracts
from lakemart.sources import feeds, sinks
from lakemart.sources.scratch import cleared

VERSIONED = "effective_date date, expiration_date date, is_current boolean, version_number int, is_inferred boolean, hash_diff string"


@dataclass
class Dimension:
    """One dimension's schema and policy: how its next snapshot follows from its source."""

    name: str
    business_key: str
    key: str
    kind: int  # 1, 2 or 3
    columns: str = ""  # the business key and attributes, with types
    attributes: Sequence[str] = ()
    tracked: str = ""  # of type 3
    type1: Sequence[str] = ()
    type0: dict[str, str] = field(default_factory=dict)
    type6: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> str:
        stem = self.tracked.removeprefix("current_")
        more = {1: "", 2: ", " + VERSIONED, 3: f", previous_{stem} string, {stem}_changed date"}[self.kind]
        return f"{self.key} int, {self.columns}{more}"

    @property
    def step(self) -> str:
        return f"Dim.{self.name}{' (SCD2)' if self.kind == 2 else ''}"

    def merge(self, dim: DataFrame, source: DataFrame, load_date: str) -> DataFrame:
        if self.kind == 2:
            return dimensions.scd2_merge(dim, source, self.business_key, self.key, self.attributes, load_date, self.type1, self.type0, self.type6)
        if self.kind == 3:
            return dimensions.scd3_merge(dim, source, self.business_key, self.tracked, self.attributes, self.key, load_date)
        return dimensions.scd1_merge(dim, source, self.business_key, self.attributes, self.key)


ROAD = ("road_code", "road_name", "road_category", "city", "district", "direction", "start_intersection", "end_intersection", "lane_count", "speed_limit")
POLICIES = (
    Dimension(
        "segment", "segment_code", "segment_key", 2,
        "segment_code string, road_code string, road_name string, road_category string, city string, district string, direction string, start_intersection string, end_intersection string, latitude decimal(9,6), longitude decimal(9,6), "
        "length_m int, lane_count int, speed_limit int, original_speed_limit int, current_speed_limit int",
        ROAD, type1=("latitude", "longitude", "length_m"), type0={"original_speed_limit": "speed_limit"}, type6={"current_speed_limit": "speed_limit"},
    ),
    Dimension("sensor", "serial_number", "sensor_key", 2, "serial_number string, sensor_type_name string, technology string, segment_code string, status_class string, install_date date, firmware_version string", ("sensor_type_name", "technology", "segment_code", "status_class"), type1=("firmware_version",), type0={"install_date": "install_date"}),
    Dimension("vehicle_type", "type_code", "vehicle_type_key", 1, "type_code string, type_name string, category string, is_heavy int", ("type_name", "category", "is_heavy")),
    Dimension("camera", "camera_code", "camera_key", 1, "camera_code string, intersection_name string, model string, resolution string, firmware_version string, status string", ("intersection_name", "model", "resolution", "firmware_version", "status")),
    Dimension("light", "controller_code", "light_key", 3, "controller_code string, intersection_name string, current_timing_plan string, cycle_seconds int, status string", ("intersection_name", "cycle_seconds", "status"), tracked="current_timing_plan"),
    Dimension("incident_type", "type_code", "incident_type_key", 1, "type_code string, type_name string, category string, default_severity int", ("type_name", "category", "default_severity")),
    Dimension("unit", "unit_code", "unit_key", 1, "unit_code string, unit_type string, home_station string, vehicle_make string, vehicle_model string", ("unit_type", "home_station", "vehicle_make", "vehicle_model")),
)
#: Dimensions whose members are generated.
STATIC = {"date": "date_key", "time": "time_key", "weather": "weather_key"}
#: What events may know before the source system does: dimension -> the event's column.
INFERRED = {"segment": "segment_code", "sensor": "sensor_serial"}
#: The dimensions with a source that the event fact looks up.
EVENT_DIMENSIONS = ("segment", "sensor", "vehicle_type", "camera")
EVENTS = "date_key int, time_key int, segment_key int, sensor_key int, camera_key int, vehicle_type_key int, weather_key int, detector_type string, event_id string, speed_kmh decimal(5,1), speed_over_limit_kmh decimal(12,1), headway_seconds decimal(6,2), occupancy_pct decimal(5,2)"
INCIDENT = "incident_number string, " + ", ".join(f"{m}_ts timestamp" for m in facts.MILESTONES) + ", current_status string, severity int, lanes_blocked int, incident_type_key int, segment_key int, unit_key int, weather_key int"
UNKNOWN_VERSION = {"effective_date": "1900-01-01", "expiration_date": dimensions.OPEN_END, "is_current": True, "version_number": 1, "is_inferred": False, "hash_diff": ""}


def with_unknown(dim: DataFrame, key: str) -> DataFrame:
    """dim with the member -1: its texts say so, and as a version it holds at all times."""
    texts = {f.name: {"condition_code": C.UNKNOWN_CODE}.get(f.name, "Unknown") for f in dim.schema if f.dataType.typeName() == "string"}
    return spines.with_unknown_member(dim, key, texts | UNKNOWN_VERSION)


def seed(spark: SparkSession, root: str, first: str, last: str) -> None:
    """A new warehouse: generated dimensions, a calendar from first to last, and in each other dimension the unknown member alone."""
    weather = spines.build_dim_weather(spark)
    made = {
        "date": spines.build_dim_date(spark, first, last), "time": spines.build_dim_time(spark),
        "weather": dimensions.numbered(weather, ("condition_code", "temp_band", "precip_band", "visibility_band"), "weather_key").withColumn("weather_key", F.col("weather_key").cast("int")),
    }
    for name, dim in made.items():
        sinks.publish(with_unknown(dim, STATIC[name]), f"{root}/{name}")
    for p in POLICIES:
        sinks.publish(with_unknown(spark.createDataFrame([], p.schema), p.key), f"{root}/{p.name}")
    sinks.publish(spark.createDataFrame([], INCIDENT), f"{root}/incidents")
    sinks.publish(spark.createDataFrame([], "table_name string, last_value timestamp"), f"{root}/watermarks")


def _put(df: DataFrame, path: str, after: sinks.Snapshot) -> sinks.Snapshot:
    """The next version of a dimension. Its rows, and those that are later versions, are counted as they are written."""
    later = F.count_if(F.col("version_number") > 1) if "version_number" in df.columns else F.count_if(F.lit(False))
    return sinks.publish(df, path, after=after.number, later=later)


def load_dimensions(spark: SparkSession, root: str, sources: dict[str, DataFrame], extracted: dict[str, int], load_date: str, log: audit.BatchLog, batch_id: int) -> dict[str, DataFrame]:
    """The next snapshot of each dimension that has a source, in the order of the policies; all as they are then."""
    out = {name: sinks.current(spark, f"{root}/{name}") for name in STATIC}
    for p in (x for x in POLICIES if x.name in sources):
        before = sinks.snapshot(spark, f"{root}/{p.name}")
        after = _put(p.merge(spark.read.parquet(before.folder), sources[p.name], load_date), f"{root}/{p.name}", before)
        out[p.name] = spark.read.parquet(after.folder)
        more, later = after.metrics["rows"] - before.metrics["rows"], after.metrics["later"] - before.metrics.get("later", 0)
        log.rows(batch_id, p.step, extracted[p.name], more - later, later)
    return out


def stage(spark: SparkSession, root: str, tables: extracts.Tables, known: dict[str, object], upper: object, full_load: bool, log: audit.BatchLog, batch_id: int, only: Sequence[str] = tuple(extracts.EXTRACTS)) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(what each extract has to give, staged; how many rows that is)."""
    sources, extracted = {}, {}
    for name, df in extracts.changed(tables, known, F.lit(upper).cast("timestamp"), full_load, only).items():
        extracted[name] = sinks.write_full(df, f"{root}/staging/{name}")["rows"]
        sources[name] = spark.read.schema(df.schema).parquet(f"{root}/staging/{name}")
        log.rows(batch_id, f"Extract.{name}", extracted[name])
    return sources, extracted


def infer_members(spark: SparkSession, root: str, dims: dict[str, DataFrame], good: DataFrame, load_date: str, log: audit.BatchLog, batch_id: int) -> None:
    """Skeletons for business keys that only events have; dims get the new snapshots."""
    for name, column in INFERRED.items():
        p = next(x for x in POLICIES if x.name == name)
        before, seen = sinks.snapshot(spark, f"{root}/{name}"), good.select(F.col(column).alias(p.business_key))
        after = _put(dimensions.infer_members(seen, dims[name], p.business_key, p.key, {}, load_date), f"{root}/{name}", before)
        dims[name] = spark.read.parquet(after.folder)
        log.rows(batch_id, f"InferredMembers.{name}", inserted=after.metrics["rows"] - before.metrics["rows"])


def load_events(spark: SparkSession, root: str, dims: dict[str, DataFrame], staged: DataFrame, load_date: str, log: audit.BatchLog, batch_id: int) -> None:
    """Inferred members, the event fact and its rejects; dims get the new snapshots."""
    day_key = int(load_date.replace("-", ""))
    good, bad = facts.transactions(staged, load_date)
    infer_members(spark, root, dims, good, load_date, log, batch_id)
    fte = facts.load_fact_event(good, dims["segment"], dims["sensor"], dims["vehicle_type"], dims["weather"], dims["camera"])
    loaded = sinks.replace_slice(fte.withColumn("date_key", F.lit(day_key)), f"{root}/fact_event", "date_key", day_key)
    rejects = cleanse.build_rejects(bad, batch_id, ("event_id", "detector_code", "segment_code", "speed_kmh", "occupancy_pct"), "sensor_serial").withColumn("date_key", F.lit(day_key))
    lost = sinks.replace_slice(rejects, f"{root}/rejects", "date_key", day_key)
    log.rows(batch_id, "Fact.TrafficEvent", staged.count(), loaded, 0, lost)


def load_hours(spark: SparkSession, root: str, dims: dict[str, DataFrame], hourly: DataFrame, fil: DataFrame, load_date: str, log: audit.BatchLog, batch_id: int) -> None:
    day_key = int(load_date.replace("-", ""))
    at = fil.select("segment_key", F.col("detected_date_key").alias("date_key"), F.hour("detected_ts").alias("hour_of_day"))
    fht = facts.hourly_snapshot(hourly, dims["segment"], dims["weather"], at, day_key).withColumn("date_key", F.lit(day_key))
    made = sinks.replace_slice(fht, f"{root}/fact_hourly", "date_key", day_key)
    log.rows(batch_id, "Fact.HourlyTraffic", hourly.where(F.col("date_key") == day_key).count(), made)


def run_events(spark: SparkSession, root: str, tables: extracts.Tables, staged: DataFrame, load_date: str, batch_id: int, upper: object) -> dict[str, DataFrame]:
    """Of one date's run on a seeded warehouse what the event fact needs: the extracts and dimensions that it looks up, and
    itself. All of these tables. Watermarks stay, so that a whole run extracts all of it again."""
    log = audit.BatchLog(spark, f"{root}/audit")
    known = {r.table_name: r.last_value for r in sinks.current(spark, f"{root}/watermarks").collect()}  # a row an extract
    with cleared(spark):
        sources, extracted = stage(spark, root, tables, known, upper, False, log, batch_id, EVENT_DIMENSIONS)
        dims = load_dimensions(spark, root, sources, extracted, load_date, log, batch_id)
        load_events(spark, root, dims, staged, load_date, log, batch_id)
    return dims | {"fte": feeds.read_known(spark, f"{root}/fact_event", EVENTS)}


def run_nightly(
    spark: SparkSession, root: str, tables: extracts.Tables, staged: DataFrame, hourly: DataFrame, load_date: str, batch_id: int, upper: object, full_load: bool = False,
    checks: Sequence[tuple[str, str, str, audit.Check]] | None = None, pipeline: str = "NightlyWarehouseRefresh",
) -> dict[str, DataFrame]:
    """One date's run on a seeded warehouse; again for the same date it gives the same warehouse. All tables, as checks see them.

    Dimensions, incidents and watermarks are published as versions: of two runs at a time one fails with sinks.Conflict.

    tables are the source system's; upper is one bound for all extracts, taken before anything is read. staged and hourly
    are the lake's events and aggregates. Steps are logged with their counts. The quality log is written and nothing is
    raised for it: the gate is the caller's. Watermarks advance last, so what failed is extracted again.
    """
    log = audit.BatchLog(spark, f"{root}/audit")
    began, day = datetime.now(timezone.utc), datetime.strptime(load_date, "%Y-%m-%d").date()
    log.put(batch_id, pipeline, day, "Running", began)
    try:
        with cleared(spark):
            out = _run(spark, root, tables, staged, hourly, load_date, batch_id, upper, full_load, checks, log)
    except Exception as e:
        log.put(batch_id, pipeline, day, "Failed", began, str(e)[:500])
        raise
    log.put(batch_id, pipeline, day, "Succeeded", began)
    return out | {"batches": log.latest()}


def _run(spark: SparkSession, root: str, tables: extracts.Tables, staged: DataFrame, hourly: DataFrame, load_date: str, batch_id: int, upper: object, full_load: bool, checks: Sequence[tuple[str, str, str, audit.Check]] | None, log: audit.BatchLog) -> dict[str, DataFrame]:
    marked = sinks.snapshot(spark, f"{root}/watermarks")
    marks = spark.read.parquet(marked.folder)
    known = {r.table_name: r.last_value for r in marks.collect()}  # a row an extract
    sources, extracted = stage(spark, root, tables, known, upper, full_load, log, batch_id)
    dims = load_dimensions(spark, root, sources, extracted, load_date, log, batch_id)
    load_events(spark, root, dims, staged, load_date, log, batch_id)
    keyed = facts.incident_keys(sources["incident"], dims["incident_type"], dims["segment"], dims["unit"], dims["weather"])
    before = sinks.snapshot(spark, f"{root}/incidents")
    after = sinks.publish(facts.upsert_lifecycle(spark.read.parquet(before.folder), keyed), f"{root}/incidents", after=before.number)
    fil = facts.lifecycle(spark.read.parquet(after.folder))
    log.rows(batch_id, "Fact.IncidentLifecycle", extracted["incident"])
    load_hours(spark, root, dims, hourly, fil, load_date, log, batch_id)
    day_key = int(load_date.replace("-", ""))
    out = dims | {
        "fte": feeds.read_known(spark, f"{root}/fact_event", EVENTS), "fil": fil, "fht": spark.read.parquet(f"{root}/fact_hourly"), "staged": staged.withColumn("date_key", F.lit(day_key)), "staged_hourly": hourly,
        "rejects": feeds.read_known(spark, f"{root}/rejects", "batch_id int, event_id string, event_ts timestamp, reject_reason string, sensor_serial string, payload string, date_key int"), "rowlog": log.row_log(), "batches": log.latest(),
    }
    results = audit.run_checks(spark, audit.catalogue() if checks is None else checks, audit.Context(out, day_key, batch_id, day_key))
    results.write.mode("append").parquet(f"{root}/quality_log")
    for source, _ in extracts.EXTRACTS.values():
        marks = feeds.advance_watermarks(marks, source, upper)
    sinks.publish(marks, f"{root}/watermarks", after=marked.number)
    log.rows(batch_id, "AdvanceWatermarks", updated=len(extracts.EXTRACTS))
    return out | {"rowlog": log.row_log(), "quality_log": spark.read.parquet(f"{root}/quality_log")}
