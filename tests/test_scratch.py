from pyspark.sql import functions as F

from lakemart.sources import scratch


def test_what_was_shuffled_for_a_written_table_is_deleted(spark):
    """As the query ends: disks are not filled until the driver's garbage is collected."""
    blocks = lambda: {f.getName() for f in _files(spark) if f.getName().startswith("shuffle_")}
    was, before = spark.conf.get(scratch.CLEANUP), blocks()
    out = scratch.written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")), "counts")
    assert not blocks() - before and spark.conf.get(scratch.CLEANUP) == was
    assert out.count() == 1000


def _files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(k) for k in range(found.size())]
