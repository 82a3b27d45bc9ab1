"""Consecutive numbers by a total order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.sources.scratch import written

#: monotonically_increasing_id has the partition above these bits and the place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, start: Column | int = 0) -> DataFrame:
    """df with `name`, the row's number by a total order, the first being start + 1.

    Rows are range-partitioned and sorted, and written so that both uses see one partitioning; each partition's count, a
    row a partition, gives the next one its start. No task sees more than its own range.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # a row a partition
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    number = F.col("_before") + place + 1 + (F.lit(start) if isinstance(start, int) else start)
    return joined.withColumn(name, number).drop("_part", "_at", "_before")
