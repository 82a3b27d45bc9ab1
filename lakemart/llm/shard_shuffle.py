"""Two-pass external shuffle into shards.

Pass one counts what a seeded hash scatters into each memory-sized bucket; prefix sums over the counts give each bucket
its place in the global order. Pass two gathers each bucket, shuffles it by Fisher-Yates and writes its rows to the
shards that its places fall into. The global order is cut into shards of equal counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemart.llm.shared import cleared, fresh_path, prefix_sums, written

#: A bucket of so many times the size aimed at, which takes many equal rows, is cut into parts.
FULL = 4
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of 0..n-1 for this seed."""
    order = np.arange(n)
    if n > 1:
        draws = np.random.default_rng(seed).integers(0, np.arange(n, 1, -1))
        for i, j in zip(range(n - 1, 0, -1), draws.tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
    return order


def kept_names(columns: list[str]) -> list[str]:
    """Names for the input's columns that no added column has, whatever the case of letters: `_in` is added, again and again while that is taken."""
    taken, out = {*OWN, *(c.lower() for c in columns)}, []
    for c in columns:
        name = c
        if c.lower() in OWN:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        out.append(name)
    return out


def shuffle_into_shards(docs: DataFrame, path: str | None = None, shards: int = 24, bucket_bytes: int = 16 << 20, seed: int = 7) -> DataFrame:
    """Write docs (doc_id, text and any other columns) to path, a folder per shard, in a random order fixed by seed; the rows as read back.

    Law `rows`: the shards' counts differ by one at most. slot is the place in the shard, from 0 without gaps; size is
    the UTF-8 bytes of the text (null: none) plus 8; text_crc32 is 0 for null; grown_shard is null, as more shards move
    rows anywhere. Buckets are drawn by a hash of doc_id and text, so groups of equal texts, rows without a doc_id and
    rows that repeat an id spread over all buckets. Rows equal in both would meet in one: a bucket over FULL times
    bucket_bytes is cut into parts by the rows' numbers in a written copy of the table, so no task holds more than its
    share. Rows equal in both are told apart by their other columns; those equal in all are exchangeable. An input column
    that has the name of an added one, in letters of any case, keeps its values under that name with `_in` added. An empty
    table gives an empty result.
    """
    path = path or fresh_path(docs.sparkSession, "shards")
    with cleared(docs.sparkSession):
        out = _placed(docs, shards, bucket_bytes, seed)
        out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _placed(docs: DataFrame, shards: int, bucket_bytes: int, seed: int) -> DataFrame:
    names = kept_names(docs.columns)
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), text)
    bucket = F.pmod(key, F.lit(buckets))
    plain = [f"`{f.name}`" for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    scattered = docs.select(
        bucket.alias("bucket"), F.xxhash64(F.lit(seed + 1), F.col("doc_id"), text).alias("key"), F.xxhash64(*plain).alias("other"), size.alias("bytes"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    counted = docs.select(bucket.alias("bucket"), F.least(size, F.lit(bucket_bytes)).alias("bytes"))  # a longer text fills a bucket, and can't be cut
    counts = written(counted.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "bucket-counts")
    full = counts.where(F.col("bytes") > FULL * bucket_bytes).select("bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("parts"))
    if not full.isEmpty():
        numbered = written(scattered.withColumn("number", F.monotonically_increasing_id()), "scattered", compression="zstd")
        cut = numbered.join(written(full, "full-buckets"), "bucket", "left")
        part = F.coalesce(F.pmod(F.xxhash64(F.lit(seed + 2), "number"), "parts"), F.lit(0))
        scattered = cut.withColumn("bucket", F.col("bucket") + part * buckets).drop("number", "parts", "bytes")
        counts = written(scattered.groupBy("bucket").agg(F.count("*").alias("n")), "part-counts")
    places = prefix_sums(counts.select("bucket", "n"), "bucket", "n")

    def shuffled(rows: pa.Table, place: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("key", "ascending"), ("other", "ascending")])
        bucket = rows.column("bucket")[0].as_py()
        order = fisher_yates(len(rows), [seed, bucket])
        start, whole = place.column("start")[0].as_py(), place.column("whole")[0].as_py()
        at = [start + i for i in range(len(rows))]
        shard = [p * shards // whole for p in at]
        slot = [p + -s * whole // shards for p, s in zip(at, shard, strict=True)]  # the shard begins at the ceiling of s * whole / shards
        return pa.table([rows.column("row").take(pa.array(order)), pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], names=["row", "shard", "slot"])

    shape = T.StructType([scattered.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    placed = scattered.drop("bytes").groupBy("bucket").cogroup(places.groupBy("bucket")).applyInArrow(shuffled, shape)
    own = F.col("row").getField("text").cast("string")
    return placed.select(
        *[F.col("row").getField(c).alias(n) for c, n in zip(docs.columns, names, strict=True)],
        (F.coalesce(F.octet_length(own), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(own.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
