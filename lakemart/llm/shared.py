"""What the operators share: tables in the cluster's shared folder, runs of sorted rows, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemart.sources.scratch import cleared, delete, discard, fresh_path, settled, shared_dir, written

__all__ = ["cleared", "components", "delete", "discard", "fitting", "fresh_path", "hooked", "matrix", "numbered", "one_of_each", "prefix_sums", "runs", "settled", "shared_dir", "written"]

def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 60) -> Iterator[pa.Table]:
    """The consecutive rows of equal keys, one run at a time, of batches that are sorted by these keys; a longer run comes in parts of `most` rows."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        if not len(b):
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        differs = np.zeros(len(b) - 1, bool)
        for c in columns:
            differs |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(differs) + 1).tolist(), len(b)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            own = tuple(c[lo] for c in columns)
            while lo < hi:
                if held and (own != last or size == most):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                n = min(hi - lo, most - size)
                held.append(b.slice(lo, n))
                lo, size, last = lo + n, size + n, own
    if held:
        yield pa.Table.from_batches(held)


def numbered(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of blocks of up to `rows` consecutive rows of equal keys; numbers ascend, and are unique over all partitions."""
    part = TaskContext.get().partitionId()
    for count, run in enumerate(runs(batches, keys, rows)):
        yield (part << 32) + count, run


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: str = "<f8") -> np.ndarray:
    """Vectors stored as bytes, as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def fitting(rows: int, dim: int, most: int = 1 << 24) -> int:
    """So many vectors of a dimension as `most` bytes hold, `rows` at most."""
    return max(16, min(rows, most // (8 * dim)))


def hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make a[k] and b[k] one tree of the forest `root`, in place: every root is the smallest member of its tree."""
    while True:
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (src, dst): one row (node, component) per node that has an edge.

    component is the smallest node reachable. Each round offers every node, and the node it points to, the smallest
    label across its edges, then follows pointers once; a star or a chain of n nodes takes about log n rounds. Only
    minima are gathered per node, with map-side combining, so a hub with very many edges costs no task more than its
    share. Labels are written to the shared folder each round.
    """
    pair = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    both = written(pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges")
    labels = written(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component")),
        "labels",
    )
    while True:
        near = labels.select(F.col("node").alias("src"), F.col("component").alias("at_src"))
        far = labels.select(F.col("node").alias("dst"), F.col("component").alias("at_dst"))
        seen = both.join(near, "src").join(far, "dst").where("at_dst < at_src")
        offers = (
            seen.select(F.explode(F.array("src", "at_src")).alias("node"), "at_dst").groupBy("node").agg(F.min("at_dst").alias("offer"))
        )
        lowered = labels.select("node", "component").join(offers, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "offer").alias("low"))
        up = lowered.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        last, labels = labels, written(lowered.join(up, "low").select("node", "was", F.least("low", "lower").alias("component")), "labels")
        discard(last)
        if labels.where("component <> was").isEmpty():
            discard(both)
            return labels.select("node", "component")


def one_of_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs, all columns, whose doc_id is among ids (doc_id), one row each. Rows without a doc_id stay as they are.

    Of rows that repeat a doc_id the one of the smallest text stays (null first), of those the one whose other columns are smallest.
    """
    others = [f.name for f in docs.schema if f.name != "text" and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    order = Window.partitionBy("id").orderBy(*[F.col("row").getField(c) for c in ("text", *others)])
    first = rows.join(ids.select(F.col("doc_id").alias("id")), "id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).union(docs.where("doc_id is null"))


def prefix_sums(totals: DataFrame, key: str, amount: str) -> DataFrame:
    """totals (one row per integer key) with `start`, the sum of amount over smaller keys, and `whole`, the sum of all.

    Sums of blocks of 1024 keys are summed first, so that no task holds more than a block or one row per block.
    """
    w = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocked = totals.withColumn("_block", F.floor(F.col(key) / 1024))
    sums = blocked.groupBy("_block").agg(F.sum(amount).alias("_in"))
    before = sums.select("_block", F.coalesce(F.sum("_in").over(w), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy()).alias("whole"))
    inner = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.join(before, "_block")
        .withColumn("start", (F.col("_before") + F.coalesce(F.sum(amount).over(inner), F.lit(0))).cast("long"))
        .drop("_block", "_before")
    )
