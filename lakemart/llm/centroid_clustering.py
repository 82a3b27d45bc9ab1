"""Centroid clustering of integer vectors, exactly, with Ptolemaic pivots.

Every vector's distances to a few fixed pivots are found once and kept beside it. For pivots p and s, a vector v and a
centroid c, Ptolemy's inequality gives d(v, c) >= |d(v, p) d(c, s) - d(v, s) d(c, p)| / d(p, s); the greatest of these
over all pivot pairs, rounded down, leaves out centroids that can't be the nearest. Those left are compared by integers.
A round is one pass over the vectors: tasks give back sums of their vectors, a few rows each, and no vector is moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.shared import settled, written

PIVOTS = 4
#: Pivots are chosen among so many vectors; the choice changes the work and never the result.
SAMPLE = 256
SLACK = 1e-12
ROWS = 4096
LIMB_BITS = 32
MOST = (1 << 63) - 1


def fits(dim: int) -> int:
    """Squared distances of vectors with components up to this are 64-bit integers."""
    return math.isqrt((1 << 61) // dim)


def packed(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, list[bool], list[bytes]]:
    """(row, small, bytes) of vectors with dim components, none null or non-finite: small ones as 32-bit integers, others as doubles."""
    sized = np.flatnonzero(np.array(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_pylist(), bool))
    values = vectors.take(pa.array(sized)).flatten()
    x = np.array(pc.fill_null(values, math.nan).to_numpy(zero_copy_only=False), float).reshape(-1, dim)
    finite = np.isfinite(x).all(axis=1)
    sized, x = sized[finite], x[finite]
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)
    small = (np.abs(whole) <= min(fits(dim), (1 << 31) - 1)).all(axis=1)
    return sized, small.tolist(), [(w.astype("<i4") if s else v).tobytes() for w, v, s in zip(whole, x, small, strict=True)]


def integers(data: list[bytes], small: bool, scale: int) -> np.ndarray:
    """Packed vectors as rows of 64-bit integers, or of Python's if they are not small."""
    if small:
        return np.frombuffer(b"".join(data), "<i4").reshape(len(data), -1).astype(np.int64)
    out = [[math.floor(v * scale) if abs(v) < 1 << 53 else int(v) * scale for v in np.frombuffer(x).tolist()] for x in data]
    return np.array(out, object).reshape(len(data), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


def roots(exact: np.ndarray) -> np.ndarray:
    """Square roots, rounded; NaN where a double can't hold the square."""
    if exact.dtype != object:
        return np.sqrt(exact.astype(float))
    return np.array([math.sqrt(v) if v.bit_length() < 1000 else math.nan for v in exact.tolist()], float)


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.stack([roots(squared(x, c)) for c in to], axis=1) if len(to) else np.zeros((len(x), 0))


def lower_bounds(own: np.ndarray, other: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Ptolemy's lower bounds of the distances of vectors and centroids from their distances to the pivots, rounded down."""
    low = np.zeros((len(own), len(other)))
    for p, s in combinations(range(len(between)), 2):
        if between[p, s] > 0:
            a, b = own[:, p, None] * other[None, :, s], own[:, s, None] * other[None, :, p]
            np.fmax(low, (np.abs(a - b) - SLACK * (a + b)) / (between[p, s] * (1 + SLACK)), out=low)  # NaN bounds nothing
    return low


def nearest(x: np.ndarray, low: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), the squared distance, and how many distances were found."""
    first = low.argmin(axis=1)
    who, best = first.copy(), squared(x, centroids[first])
    found, floor = len(x), low * low * (1 - SLACK)
    for k, c in enumerate(centroids):
        left = np.flatnonzero((floor[:, k] <= best.astype(float)) & (first != k)) if best.dtype != object else np.flatnonzero(first != k)
        d = squared(x[left], c)
        found += len(left)
        better = (d < best[left]) | ((d == best[left]) & (k < who[left]))
        at = left[better.astype(bool)]
        who[at], best[at] = k, d[better.astype(bool)]
    return who, best, found


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """An integer of any size as (place, digit) in base 2^32; the last digit has the sign."""
    place, half = 0, 1 << (LIMB_BITS - 1)
    while not -half <= value < half:
        yield place, value & ((1 << LIMB_BITS) - 1)
        value >>= LIMB_BITS
        place += 1
    yield place, value


class Assigner:
    """What tasks need to assign vectors: centroids, pivots, and the distances between them. Its size is that of k + PIVOTS vectors."""

    def __init__(self, centroids: list[list[int]], pivots: list[list[int]], dim: int, scale: int):
        self.scale = scale
        self.small = all(abs(v) <= fits(dim) for c in (*centroids, *pivots) for v in c)
        self.centroids, self.pivots = (np.array(x, np.int64 if self.small else object).reshape(-1, dim) for x in (centroids, pivots))
        self.other, self.between = distances(self.centroids, self.pivots), distances(self.pivots, self.pivots)

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their vectors) of a batch, small vectors and others apart."""
        small = np.array(batch.column("small").to_pylist(), bool)
        for kind in (True, False):
            at = np.flatnonzero(small == kind)
            for k in range(0, len(at), ROWS):
                some = at[k : k + ROWS]
                x = integers(batch.column("x").take(pa.array(some)).to_pylist(), kind, self.scale)
                yield some, x if self.small else x.astype(object)

    def kept(self, batch: pa.RecordBatch) -> np.ndarray:
        """The distances to the pivots that are kept beside the vectors."""
        return np.frombuffer(b"".join(batch.column("pivots").to_pylist()), float).reshape(len(batch), -1)

    def assign(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, vectors, nearest centroid, squared distance)."""
        own = self.kept(batch)
        for some, x in self.rows(batch):
            who, best, _ = nearest(x, lower_bounds(own[some], self.other, self.between), self.centroids)
            yield some, x, who, best


def _packed(dim: int, scale: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, small, x = packed(b.column("v"), dim, scale)
            yield pa.record_batch([b.column("vec_id").take(pa.array(row)), pa.array(small, pa.bool_()), pa.array(x, pa.binary())], names=["vec_id", "small", "x"])

    return of


def _measured(shipped):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            own = np.zeros((len(b), len(model.pivots)))
            for some, x in model.rows(b):
                own[some] = distances(x, model.pivots)
            yield pa.record_batch([*b.columns, pa.array([d.tobytes() for d in own], pa.binary())], names=["vec_id", "small", "x", "pivots"])

    return of


def _summed(shipped):
    """Rows -> a task's sums: (cluster, part, place, digit); parts are the components and, last, the count."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        k, dim = model.centroids.shape
        total = np.zeros((k, dim + 1), object)
        for b in batches:
            for _, x, who, _ in model.assign(b):
                for c in np.unique(who).tolist():
                    own = x[who == c]
                    total[c] += np.array([*own.sum(axis=0).tolist(), len(own)], object)
        rows = [(c, part, *digit) for c in range(k) if total[c, dim] for part in range(dim + 1) for digit in limbs(int(total[c, part]))]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "part", "place", "digit"])

    return of


def _assigned(shipped):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            for some, _, who, best in model.assign(b):
                yield pa.record_batch([b.column("vec_id").take(pa.array(some)), pa.array(who.astype(np.int32)), pa.array([min(MOST, v) for v in best.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    return of


def farthest_first(x: np.ndarray, most: int) -> list[int]:
    """Rows far from each other: the first, then always the one farthest from those taken (ties: the first)."""
    taken, near = [], [math.inf] * len(x)
    while len(taken) < min(most, len(x)):
        at = max(range(len(x)), key=lambda k: near[k]) if taken else 0
        if taken and near[at] == 0:
            break
        taken.append(at)
        near = [min(a, b) for a, b in zip(near, squared(x, x[at]).tolist(), strict=True)]
    return taken


def order_of(vec_id: str, seed: int) -> Column:
    """Lower-case hexadecimal SHA-256 of `seed:vec_id`; a null id is empty text."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector of `vectors` (vec_id, embedding).

    Vectors are kept that have dim components, none null or non-finite; component x counts as the integer floor(scale * x).
    Centroids start as the k vectors of the smallest order_of, of rows that share an id those of the smallest components;
    fewer vectors give fewer centroids. Each round assigns every vector to its nearest centroid and replaces each
    centroid that has vectors by the floor of their mean, exactly. Ties go to the smaller number. Null and repeated ids
    are kept, and each row counts. Distances and their sums past a long are given as the greatest long. Other columns are
    ignored. An empty table gives an empty result.
    """
    return settled(vectors.sparkSession, "clusters", lambda: _cluster(vectors, k, rounds, dim, scale, seed))


def _cluster(vectors: DataFrame, k: int, rounds: int, dim: int, scale: int, seed: int) -> DataFrame:
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    sized = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == dim)
    whole = sized.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < math.inf)))
    some = whole.select(order_of("vec_id", seed).alias("order"), "v").orderBy("order", "v").limit(max(k, SAMPLE)).collect()  # of bounded size
    sample = [[int(x * scale // 1) if abs(x) < 1 << 53 else int(x) * scale for x in r.v] for r in some]
    centroids = sample[:k]
    pivots = [sample[j] for j in farthest_first(np.array(sample, object).reshape(-1, dim), PIVOTS)]

    def shipped():
        return spark.sparkContext.broadcast(Assigner(centroids, pivots, dim, scale))  # k + PIVOTS vectors

    rows = sized.mapInArrow(_packed(dim, scale), f"vec_id {kind}, small boolean, x binary")
    kept = written(rows.mapInArrow(_measured(shipped()), f"vec_id {kind}, small boolean, x binary, pivots binary"), "vectors")
    for _ in range(rounds if centroids else 0):
        sums = kept.mapInArrow(_summed(shipped()), "cluster int, part int, place int, digit long").groupBy("cluster", "part", "place").agg(F.sum("digit").alias("digit"))
        total: dict[tuple[int, int], int] = {}
        for r in sums.collect():  # a few rows a component of a centroid
            total[r.cluster, r.part] = total.get((r.cluster, r.part), 0) + (r.digit << (LIMB_BITS * r.place))
        centroids = [[total[c, j] // n for j in range(dim)] if (n := total.get((c, dim))) else own for c, own in enumerate(centroids)]
    assigned = written(kept.mapInArrow(_assigned(shipped()), f"vec_id {kind}, cluster int, distance long"), "assigned")
    most = F.lit(MOST).cast("decimal(38,0)")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = F.sum("own").over(Window.partitionBy())  # a row a cluster
    sums = sums.select("cluster", F.least("own", most).cast("long").alias("cluster_inertia"), F.least(whole, most).cast("long").alias("inertia"))
    names = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    named = sums.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
