"""Reading feeds and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.sources.json_arrays import read_json_array

# The feeds' fields.
SENSOR_SCHEMA = (
    "event_id string, event_ts timestamp, sensor_serial string, segment_code string, direction string, vehicle_type_code string, "
    "speed_kmh decimal(5,1), headway_seconds decimal(6,2), occupancy_pct decimal(5,2), _corrupt_record string"
)
CAMERA_SCHEMA = (
    "event_id string, camera_code string, detection struct<timestamp:timestamp,segment_code:string,direction:string,"
    "vehicle_class:string,speed_kmh:decimal(5,1),plate_hash:string>, _corrupt_record string"
)
WEATHER_SCHEMA = (
    "station_code string, observed_at timestamp, temperature_c double, precipitation_mm double, wind_speed_kmh double, "
    "visibility_m int, condition_code string, _corrupt_record string"
)
MANIFEST_FIELDS = "date:date,sensor_csv_rows:long,camera_events:long"


def pattern(folder: str, feed: str, kind: str, load_date: str | None) -> str:
    """The feed's files of one date, or of all."""
    return f"{folder}/{feed}_{load_date.replace('-', '') if load_date else '*'}.{kind}"


def ingest_date(path: Column) -> Column:
    """The date in a file's name, or in that of its folder if a feed comes in parts, whatever its rows say; null if there is none."""
    return F.try_to_timestamp(F.regexp_extract(path, r"_(\d{8})\.[a-z]+(?:/[^/]*)?$", 1), F.lit("yyyyMMdd")).cast("date")


def add_audit(df: DataFrame, source: str, batch_id: int, path: Column | None = None) -> DataFrame:
    """df with where and when its rows came from; path: the file of each, if df is not itself a scan."""
    path = F.col("_metadata.file_path") if path is None else path
    return df.select("*", F.current_timestamp().alias("_ingest_ts"), path.alias("_source_file"), F.lit(source).alias("_source"), F.lit(batch_id).alias("_batch_id"), ingest_date(path).alias("ingest_date"))


def read_csv_feed(spark: SparkSession, path: str, schema: str = SENSOR_SCHEMA, batch_id: int = 0) -> DataFrame:
    """Lines that don't fit the schema are kept in _corrupt_record."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    return add_audit(rows, "sensor", batch_id).withColumn("event_date", F.to_date("event_ts"))


def read_camera_json(spark: SparkSession, path: str, batch_id: int = 0) -> DataFrame:
    """Arrays of events, however large a file: see read_json_array."""
    rows = read_json_array(spark, path, CAMERA_SCHEMA)
    lifted = add_audit(rows, "camera", batch_id, F.col("_path")).drop("_path").withColumn("event_ts", F.col("detection.timestamp"))
    return lifted.withColumn("event_date", F.to_date("event_ts"))


def read_weather_json(spark: SparkSession, path: str, batch_id: int = 0) -> DataFrame:
    """Arrays of observations, however large a file: see read_json_array."""
    rows = read_json_array(spark, path, WEATHER_SCHEMA)
    return add_audit(rows, "weather", batch_id, F.col("_path")).drop("_path").withColumnRenamed("observed_at", "observed_ts").withColumn("event_date", F.to_date("observed_ts"))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The few rows of a manifest, which readers of data would pass over if its name begins with an underscore."""
    fs, at = _file(spark, path)
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.createDataFrame([(text,)], "text string").select(F.inline(F.from_json("text", f"array<struct<{MANIFEST_FIELDS}>>")))


def read_known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dataset of known columns that may have no file, or not be there, yet."""
    fs, at = _file(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def read_zone(spark: SparkSession, path: str, date_column: str, load_date: str | None = None) -> DataFrame:
    """A partitioned dataset; of one date, no other partition is opened."""
    rows = spark.read.parquet(path)
    return rows if load_date is None else rows.where(F.col(date_column) == F.lit(load_date).cast("date"))


def incremental_extract(df: DataFrame, column: str, last: Column | None, upper: Column, full_load: bool = False) -> DataFrame:
    """Rows changed after the last watermark, up to a bound that is taken once for all tables."""
    low = F.lit("1900-01-01").cast("timestamp") if full_load or last is None else last
    return df.where((F.col(column) > low) & (F.col(column) <= upper))


def advance_watermarks(marks: DataFrame, table: str, upper: object) -> DataFrame:
    """The next watermark table (table_name, last_value); a null bound changes nothing. To be called when all else is done."""
    new = F.lit(upper).cast(marks.schema["last_value"].dataType)
    own = F.col("table_name") == table
    kept = marks.withColumn("last_value", F.when(own, F.coalesce(new, F.col("last_value"))).otherwise(F.col("last_value")))
    added = marks.sparkSession.range(1).select(F.lit(table).alias("table_name"), new.alias("last_value")).where("last_value is not null")
    return kept.unionByName(added.join(marks.select("table_name"), "table_name", "left_anti").select(marks.columns))
