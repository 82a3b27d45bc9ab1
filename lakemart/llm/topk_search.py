"""Exact top-k by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Candidates are sorted by length and cut into blocks; queries are cut into blocks as well. A first look at the longest
candidates gives each query a score that its k-th best can't be under. A block of candidates is left out for a block of
queries whose floors its greatest length can't reach. A task holds one block of queries and passes some blocks of
candidates by it, longest first: the inner product over the first few rotated coordinates plus the product of the
remaining lengths bounds each score, what passes is scored in whole numbers, and the floors rise as it goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.shared import fitting, matrix, runs, settled, written
from lakemart.operators.numbering import numbered

SCALE = 1024
#: Products of lengths under which inner products are exact in doubles and in 64-bit integers.
EXACT, LONG = 1 << 53, 1 << 62
MOST = (1 << 63) - 1
VECTORS = "row long, vec_id long, dim int, length double, x binary"
Rotation = dict[int, np.ndarray]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (row, vec_id, dim, length, x): x as whole numbers in doubles; rows that take no part are left out."""
    part, count = TaskContext.get().partitionId(), 0
    for b in batches:
        rows = []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
            x = v.values.to_numpy(zero_copy_only=False).astype(float) if v.is_valid and v.values.null_count == 0 else np.empty(0)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * x)
            if i is not None and len(x) and np.isfinite(x).all():
                most = max(1.0, float(np.abs(x).max()))
                rows.append(((part << 33) + count, i, len(x), most * float(np.sqrt(((x / most) ** 2).sum())), x.astype("<f8").tobytes()))
                count += 1
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()), strict=True)], names=["row", "vec_id", "dim", "length", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per coordinate and dimension: this partition's sums of products of the vectors' directions."""
    sums: Rotation = {}
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims):
            own = b.filter(pa.array(dims == d))
            unit = matrix(own.column("x"), d) / np.maximum(own.column("length").to_numpy(), 1.0)[:, None]
            sums[int(d)] = sums.get(int(d), 0) + unit.T @ unit
    rows = [(d, i, j, s[i, j]) for d, s in sums.items() for i in range(d) for j in range(d)]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["dim", "i", "j", "s"])


def rotations(vectors: DataFrame) -> Rotation:
    """Per dimension, the right singular vectors of all vectors' directions, largest first: from dim x dim sums that Spark adds up."""
    sums = vectors.select("dim", "length", "x").mapInArrow(_moments, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    dim, i, j, s = (sums.column(c).to_numpy() for c in ("dim", "i", "j", "s"))
    out = {}
    for d in np.unique(dim):
        m, own = np.zeros((d, d)), dim == d
        m[i[own], j[own]] = s[own]
        out[int(d)] = np.linalg.eigh(m)[1][:, ::-1]
    return out


def blocked(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors with their block: `rows` neighbours by descending length, of one dimension. Blocks of a dimension are numbered by descending length.

    Numbers run over all partitions, so blocks are full however many partitions there are.
    """
    placed = numbered(vectors, ("dim", F.desc("length"), "row"), "number")
    return placed.withColumn("block", F.col("dim") * F.lit(1 << 40) + F.floor((F.col("number") - 1) / rows)).drop("number")


def integer_products(query: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Row by row, the exact inner product of whole numbers, at the ends of a long's range where it is beyond them. bound is one of its size."""
    if bound < EXACT:
        return np.rint(np.einsum("ij,ij->i", query, x)).astype(np.int64)
    if bound < LONG:
        return np.einsum("ij,ij->i", query.astype(np.int64), x.astype(np.int64))
    sums = (sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for p, q in zip(query.tolist(), x.tolist(), strict=True))
    return np.array([max(-MOST - 1, min(MOST, s)) for s in sums], np.int64)


class Block:
    """Vectors with what their bounds need: rotated first coordinates, and the length of the rest."""

    def __init__(self, table: pa.Table, rotation: np.ndarray):
        self.row, self.ids = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
        self.length = table.column("length").to_numpy()
        self.x = matrix(table.column("x"), len(rotation))
        unit = self.x / np.maximum(self.length, 1.0)[:, None]
        some = unit @ rotation[:, : max(1, len(rotation) // 4)]
        whole = np.where(self.length > 0, 1.0, 0.0)
        self.rest = np.sqrt(np.maximum(0, whole - (some**2).sum(axis=1))) * self.length
        self.some = some * self.length[:, None]


class Best:
    """The k best of each query so far: higher scores first, of equal ones the smaller vec_id."""

    def __init__(self, queries: Block, floor: np.ndarray, k: int):
        self.queries, self.floor, self.k = queries, floor.copy(), k
        self.query, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.floor[query]
        query, ids, score = (np.concatenate(c) for c in ((self.query, query[keep]), (self.ids, ids[keep]), (self.score, score[keep])))
        order = np.lexsort((ids, ~score, query))  # ~ turns the order around, for the least long as well
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        first = place < self.k
        self.query, self.ids, self.score = query[first], ids[first], score[first]
        last = np.flatnonzero(place == self.k - 1)
        rises = last[score[last] > -MOST - 1]
        np.maximum.at(self.floor, query[rises], score[rises].astype(float))

    def look(self, other: Block, step: int = 512) -> None:
        """Pass candidates, longest first, until no query's floor can be reached."""
        q = self.queries
        for at in range(0, len(other.row), step):
            part = slice(at, at + step)
            with np.errstate(over="ignore", invalid="ignore"):
                reach = q.length * other.length[at] * (1 + 1e-9) + 1
                live = np.flatnonzero(~(reach < self.floor))
                if not len(live):
                    break
                product = np.outer(q.length[live], other.length[part])
                bound = q.some[live] @ other.some[part].T + np.outer(q.rest[live], other.rest[part]) + 1e-6 * (1 + product)
                passes = ~(bound < self.floor[live, None]) & (q.row[live, None] != other.row[None, part])
            a, b = np.nonzero(passes)
            if not len(a):
                continue
            most = float(np.nan_to_num(product.max(), nan=np.inf))
            if most < EXACT and len(a) * 8 > passes.size:
                score = np.rint(q.x[live] @ other.x[part].T).astype(np.int64)[a, b]
            else:
                score = np.concatenate([integer_products(q.x[live[a[s : s + 65536]]], other.x[at + b[s : s + 65536]], most) for s in range(0, len(a), 65536)])
            self.add(live[a], other.ids[at + b], score)


def _score(turns: Rotation, k: int, floors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by task, with its queries (kind 0) before its blocks of candidates -> best scores, or each query's k-th best (floors)."""

    def done(best: Best | None) -> Iterator[pa.RecordBatch]:
        if best is None:
            return
        if floors:
            yield pa.record_batch([pa.array(best.queries.row), pa.array(best.floor)], names=["row", "floor"])
        else:
            q = best.queries
            yield pa.record_batch([pa.array(q.row[best.query]), pa.array(q.ids[best.query]), pa.array(best.ids), pa.array(best.score)], names=["row", "query_id", "vec_id", "score"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        for run in runs(batches, ["query_block", "slice", "kind", "turn"]):
            rotation = turns[run.column("dim")[0].as_py()]
            if run.column("kind")[0].as_py() == 0:
                yield from done(best)
                best = Best(Block(run, rotation), run.column("floor").to_numpy(), k)
            else:
                best.look(Block(run, rotation))
        yield from done(best)

    return of


def _passed(queries: DataFrame, candidates: DataFrame, pairs: DataFrame, turns: Rotation, k: int, floors: bool) -> DataFrame:
    """Scores of pairs (query_block, slice, block, turn): each task gets its queries once, and its blocks of candidates by turn."""
    columns = ("query_block", "slice", "kind", "turn", "row", "vec_id", "dim", "length", "x", "floor")
    asked = queries.join(pairs.select("query_block", "slice").distinct(), "query_block").withColumns({"kind": F.lit(0), "turn": F.lit(0).cast("long")})
    passing = candidates.join(pairs, "block").withColumns({"kind": F.lit(1), "floor": F.lit(0.0)})
    task = asked.select(*columns).unionByName(passing.select(*columns)).repartition("query_block", "slice").sortWithinPartitions("query_block", "slice", "kind", "turn", F.desc("length"), "row")
    return task.mapInArrow(_score(turns, k, floors), "row long, floor double" if floors else "row long, query_id long, vec_id long, score long")


def search(embeddings: DataFrame, every: int = 100, k: int = 10, block: int = 1024, query_block: int = 4096, in_task: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k best other rows.

    Components become floor(1024 * x) in double precision; scores are integer inner products, exact at any size; one that
    a long can't hold is given as the nearest long, and ranked as that. Ties go to the smaller vec_id, and all are
    returned if there are fewer than k. Vectors that are null or empty or hold a null or non-finite component (or one
    whose 1024-fold is no finite double) take no part, nor do rows without a vec_id; a query meets vectors of its own
    dimension, but not its own row. Repeated rows are candidates of each other and each asks. Other columns are ignored.

    A task holds up to `query_block` queries and passes up to `in_task` blocks of candidates by them; long vectors make smaller blocks.
    """
    return settled(embeddings.sparkSession, "best", lambda: _search(embeddings, every, k, block, query_block, in_task))


def _search(embeddings: DataFrame, every: int, k: int, block: int, query_block: int, in_task: int) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = written(rows.mapInArrow(_whole, VECTORS), "vectors")
    turns = rotations(vectors)
    block, query_block = (fitting(n, max(turns, default=1)) for n in (block, query_block))
    candidates = blocked(vectors, block)
    asked = blocked(vectors.where(F.col("vec_id") % every == 0), query_block).withColumnRenamed("block", "query_block")
    blocks = written(candidates.groupBy("dim", "block").agg(F.max("length").alias("longest")), "blocks")
    # The first look is at the longest block of each dimension: one row a dimension.
    first = blocks.groupBy("dim").agg(F.max_by("block", F.struct("longest", -F.col("block"))).alias("block"))
    looks = asked.select("query_block", "dim").distinct().join(F.broadcast(first), "dim").select("query_block", "block", F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("turn"))
    longest = candidates.join(F.broadcast(first), ["dim", "block"], "left_semi")
    floors = _passed(asked.withColumn("floor", F.lit(float("-inf"))), longest, looks, turns, k, True)
    queries = written(asked.join(floors, "row"), "floors")
    # The length that a block needs to reach any of a query block's floors.
    least = F.min(F.when(F.col("length") > 0, (F.col("floor") - 1) / (F.col("length") * (1 + 1e-9))).otherwise(float("-inf")))
    wanted = queries.groupBy("query_block", "dim").agg(least.alias("least"))
    # Blocks are dealt over salts, so that no task pairs all of a dimension; neighbours by length share a slice.
    spread = min(256, 1 + blocks.count() // 64)
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(spread)))
    met = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))).join(salted, ["dim", "salt"]).where(~(F.col("longest") < F.col("least")))
    pairs = written(met.select("query_block", F.floor(F.col("block") / in_task).alias("slice"), "block", F.col("block").alias("turn")), "pairs")
    scores = _passed(queries, candidates, pairs, turns, k, False)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

