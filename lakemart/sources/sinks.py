"""Writing zones, facts and staging tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakemart.sources.scratch import cleared, written

#: Rows of one file take so many bytes in the shuffle before it; as columns they take a half to a fifth of that. A task
#: sorts what it writes, and in memory rows take some twelve times their compressed bytes in the shuffle.
FILE_BYTES = 32 << 20
TARGET = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: So many snapshots of a table stay for those who still read them.
KEEP = 10


class Conflict(RuntimeError):
    """Another writer has published the version that was to be."""


@contextmanager
def _aimed_at(spark: SparkSession, file_bytes: int) -> Iterator[None]:
    was = spark.conf.get(TARGET, None)
    spark.conf.set(TARGET, str(file_bytes))
    try:
        yield
    finally:
        spark.conf.unset(TARGET) if was is None else spark.conf.set(TARGET, was)


def _observed(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df, and what will be known of its rows once it is written: nothing is counted again, and a task that is repeated counts once."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in metrics.items()]), seen


def write_partitioned(df: DataFrame, path: str, by: str, codec: str = "zstd", sort: Sequence[str] = (), file_bytes: int = FILE_BYTES) -> int:
    """Replace the partitions that df has; how many rows were written. df is run once.

    Rows are gathered by date. A date of more than `file_bytes` of shuffled rows is dealt to as many tasks as it takes,
    each of which writes a file sorted by `sort`; dates with less have one file each, and tasks take several of them.
    """
    rows, seen = _observed(df.hint("rebalance", F.col(by)).sortWithinPartitions(by, *sort), {})
    with _aimed_at(df.sparkSession, file_bytes):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy(by).parquet(path)
    return seen.get["rows"]


def write_full(df: DataFrame, path: str, codec: str = "zstd", **metrics: Column) -> dict[str, int]:
    """Replace a whole dataset; its `rows` and what `metrics`, aggregates by name, say of them."""
    rows, seen = _observed(df, metrics)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", codec).parquet(path)
    return seen.get


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(Hadoop's file system, its name of the path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_slice(spark: SparkSession, path: str, by: str, value: object) -> bool:
    """Remove one partition's folder through Hadoop's file system; is there one?"""
    fs, at = _at(spark, f"{path}/{by}={value}")
    return fs.delete(at, True)


def replace_slice(df: DataFrame, path: str, by: str, value: object, **options: object) -> int:
    """Replace one partition by df's rows of it; how many there are. df is run once.

    Dynamic overwrite leaves a partition that gets no row as it was, so that one is dropped then.
    """
    rows = write_partitioned(df.where(F.col(by) == F.lit(value)), path, by, **options)
    if not rows:
        drop_slice(df.sparkSession, path, by, value)
    return rows


@dataclass(frozen=True)
class Snapshot:
    """A published version of a table: its number, its folder, and what was observed as it was written."""

    number: int
    folder: str
    metrics: dict[str, int]
    carried: tuple[str, ...] = ()  # parts of earlier versions' folders that belong to this one as they are


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's published versions, ascending."""
    return sorted(int(x) for x in _names(spark, f"{path}/_versions") if x.isdigit())


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot | None:
    """A version of a table, by default the latest; None if there is none."""
    number = number or max(versions(spark, path), default=None)
    if number is None:
        return None
    fs, at = _at(spark, f"{path}/_versions/{number:012d}")
    stream = fs.open(at)
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(number, f"{path}/{told['folder']}", told["metrics"], tuple(f"{path}/{x}" for x in told.get("carried", ())))


def _commit(spark: SparkSession, path: str, number: int, folder: str, metrics: dict[str, int], carried: Sequence[str] = ()) -> None:
    """Name a folder as a version. The pointer is written under another name and then renamed, so it is there whole or not
    at all; Hadoop's rename takes no name that is in use, so of two writers one fails."""
    fs, draft = _at(spark, f"{path}/_drafts/{folder}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps({"folder": folder, "metrics": metrics, "carried": [*carried]}), "utf-8"))
    finally:
        stream.close()
    _, at = _at(spark, f"{path}/_versions/{number:012d}")
    fs.mkdirs(at.getParent())
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise Conflict(f"{path}: version {number} was published by another writer")


def publish(df: DataFrame, path: str, after: int | None = None, keep: int = KEEP, **metrics: Column) -> Snapshot:
    """Write the next version of a table in a folder of its own, and then name it; current() finds it from then on.

    after: the version that df was made from, by default the latest as the writing begins. Conflict, and nothing else, if
    another writer has published since. A writer that dies at any point leaves the last version as it is. `keep` versions
    stay; the folders of older ones go, and with them those that no version names.
    """
    spark = df.sparkSession
    number = (max(versions(spark, path), default=0) if after is None else after) + 1
    folder = f"v-{number:012d}-{uuid.uuid4().hex}"
    told = write_full(df, f"{path}/{folder}", **metrics)
    try:
        _commit(spark, path, number, folder, told)
    except Conflict:
        fs, at = _at(spark, f"{path}/{folder}")
        fs.delete(at, True)
        raise
    expire(spark, path, keep)
    return Snapshot(number, f"{path}/{folder}", told)


def publish_parts(parts: dict[str, DataFrame], path: str, after: int, carry: Sequence[str] = (), keep: int = KEEP) -> Snapshot:
    """As publish, a version that has several parts, each a folder of its own; `carry` are parts of the version `after` that
    stay as they are: they are named again, not written again. Conflict as there. Metrics: rows of each part that is written."""
    spark, number = next(iter(parts.values())).sparkSession, after + 1
    folder = f"v-{number:012d}-{uuid.uuid4().hex}"
    told = {name: write_full(df, f"{path}/{folder}/{name}")["rows"] for name, df in parts.items()}
    kept = [x.removeprefix(f"{path}/") for x in carry]
    try:
        _commit(spark, path, number, folder, told, kept)
    except Conflict:
        fs, at = _at(spark, f"{path}/{folder}")
        fs.delete(at, True)
        raise
    expire(spark, path, keep)
    return Snapshot(number, f"{path}/{folder}", told, tuple(carry))


def expire(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Forget all versions but the last `keep`, their names first. Folders that were never named go when their number is
    past, and so do those that the versions which stay carry nothing of."""
    last = max(versions(spark, path), default=0) - max(1, keep)
    old = [f"_versions/{n:012d}" for n in versions(spark, path) if n <= last]
    past = [x for x in _names(spark, path) if x.startswith("v-") and int(x.split("-")[1]) <= last]
    used = {c.removeprefix(f"{path}/").split("/")[0] for n in versions(spark, path) if n > last for c in snapshot(spark, path, n).carried} if past else set()
    old += [x for x in past if x not in used]
    old += [f"_drafts/{x}" for x in _names(spark, f"{path}/_drafts") if x.startswith("v-") and int(x.split("-")[1]) <= last]
    for x in old:
        fs, at = _at(spark, f"{path}/{x}")
        fs.delete(at, True)


def current(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The latest version of a published table, or the one of a number. It stays readable while later ones are published, up to KEEP."""
    found = snapshot(spark, path, number)
    if found is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(found.folder)


def write_jdbc(df: DataFrame, url: str, table: str, truncate: bool = True, batch: int = 10_000, mode: str | None = None, **properties: str) -> None:
    """Bulk insert in batches, after truncating or behind what is there; mode="overwrite" without truncating makes the table anew."""
    writer = df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, truncate=str(truncate).lower(), **properties)
    writer.mode(mode or ("overwrite" if truncate else "append")).save()


def _sql_name(name: str) -> str:
    if not name.replace("_", "").replace(".", "").isalnum():
        raise ValueError(f"not a plain name: {name}")
    return name


def _in_transaction(spark: SparkSession, url: str, properties: dict[str, str], statements: Sequence[tuple[str, Sequence[object]]]) -> list[int]:
    """Run statements with their parameters in one transaction of the database; how many rows each has touched."""
    if "driver" in properties:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    given = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        touched = []
        try:
            for sql, values in statements:
                statement = connection.prepareStatement(sql)
                for at, v in enumerate(values, 1):
                    statement.setObject(at, spark._jvm.java.sql.Date.valueOf(v.isoformat()) if isinstance(v, date) else v)
                touched.append(statement.executeUpdate())
                statement.close()
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        return touched
    finally:
        connection.close()


def replace_jdbc_slice(df: DataFrame, url: str, table: str, by: str, value: object, connections: int = 8, batch: int = 10_000, **properties: str) -> int:
    """Replace a table's rows of one `by` value (a number, text or date) by df's; how many there are.

    Rows go to `<table>_stage` by at most `connections` tasks, each with one connection. One transaction then deletes the
    slice and inserts the stage, so readers see the old slice or the new one, and a load that fails, anywhere, leaves the
    old one. It may be repeated: the next load replaces the stage. Rows are numbered before they are staged, and of those
    that share a number one is taken, so a task that runs twice, its first rows being committed already, adds nothing.
    The table must be there.
    """
    spark, stage = df.sparkSession, f"{_sql_name(table)}_stage"
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    there = {c.lower(): c for c in spark.read.format("jdbc").options(url=url, dbtable=table, **properties).load().columns}  # the table's own case
    into = ", ".join(quote(there[c.lower()]) for c in df.columns)
    staged, row, copy = ", ".join("s." + quote(c) for c in df.columns), quote("load_row"), quote("load_copy")
    with cleared(spark):
        rows = written(df.where(F.col(by) == F.lit(value)).withColumn("load_row", F.monotonically_increasing_id()), "jdbc-slice")
        told_apart = F.xxhash64(F.reflect(F.lit("java.util.UUID"), F.lit("randomUUID")))  # unlike uuid(), another one when a task runs again
        write_jdbc(rows.coalesce(connections).withColumn("load_copy", told_apart), url, stage, truncate=False, mode="overwrite", batch=batch, **properties)
    _, inserted = _in_transaction(spark, url, properties, [
        (f"DELETE FROM {table} WHERE {quote(there[by.lower()])} = ?", [value]),
        (f"INSERT INTO {table} ({into}) SELECT {staged} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {stage} o WHERE o.{row} = s.{row} AND o.{copy} < s.{copy})", []),
    ])
    return inserted


# The columns of the two staging contracts, by the name that they have in the lake.
STAGED_EVENT = {c: c for c in (
    "event_id", "event_ts", "detector_type", "detector_code", "sensor_serial", "camera_code", "segment_code", "vehicle_type_code", "speed_kmh", "headway_seconds", "occupancy_pct",
    "condition_code", "avg_temp_c", "precipitation_mm", "visibility_m", "event_date", "ingest_date", "_source_file",
)}
STAGED_HOURLY = {c: c for c in (
    "event_date", "date_key", "hour_of_day", "segment_code", "vehicle_count", "heavy_vehicle_count", "avg_speed", "p85_speed", "avg_occupancy", "condition_code", "avg_temp_c", "precipitation_mm", "visibility_m",
)}


def to_staging(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The columns that a staging table takes, under its names."""
    return df.select(*[F.col(c).alias(n) for c, n in mapping.items()])
