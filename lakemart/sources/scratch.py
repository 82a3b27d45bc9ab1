"""Tables that jobs write for themselves in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What is written within the innermost `cleared` of this thread, and the ones around it: jobs of other threads have their own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("_open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, local mode alone gets one of its own, as tests do."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-lakemart-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if within := _open.get():
        within[-1].append(path)
    return path


#: Shuffle files go when the query that made them has ended, in place of when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, a lost executor loses nothing, and what was shuffled for it is deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _clean_shuffles(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    delete(df.sparkSession, df.written_to)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, every table that was written to the shared folder within: what is kept must be written before, elsewhere."""
    paths: list[str] = []
    outer = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(outer)
        for path in paths:
            delete(spark, path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame], **options: str) -> DataFrame:
    """What `make` gives, written to the shared folder; all tables that it wrote on the way are deleted."""
    path = fresh_path(spark, name)
    with cleared(spark):
        out = make()
        with _clean_shuffles(spark):
            out.write.options(**options).parquet(path)
    return spark.read.schema(out.schema).parquet(path)
