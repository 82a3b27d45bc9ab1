"""Exact near-duplicate vectors by dual traversal of cover trees.

Equal vectors of a label are one point. The upper levels of a label's cover tree, nested nets whose radii halve, are laid
over a bounded sample of its points; every point then goes to the nearest node of the last level, and a node's points,
sorted by their distance from it, are cut into blocks. Each block gets the lower levels of its own. Two blocks, and two
nodes of their trees, are left out when their centres are farther apart than their covering radii and the threshold
allow; nodes that lie wholly within the threshold of each other link as wholes, so a dense group is counted and connected
without naming its pairs. A node whose net needs many centres prunes nothing (in high dimension most are so): its
points are compared by matrix products.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.shared import components, fitting, hooked, matrix, numbered, runs, settled, written

EDGE = 1e-7
LEAF = 64
CENTRES = 64
STRIP = 256
#: Of the upper levels: nodes of a label's last level, labels that have some, and points of the sample and their bytes, at most.
CELLS, LABELS, SAMPLE, SAMPLE_BYTES = 256, 1000, 1 << 15, 1 << 23
Nets = dict[tuple[str, int], np.ndarray]


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def net(unit: np.ndarray, start: list[int], r: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres more than r apart that begin with `start`, each point's nearest and its squared distance; None if more than `most` are needed."""
    centres: list[int] = []
    near, owner = np.full(len(unit), np.inf), np.zeros(len(unit), np.int64)
    todo = list(start)
    while todo:
        c = todo.pop(0)
        if len(centres) == most:
            return None
        far = np.maximum(0, 2 - 2 * (unit @ unit[c]))
        far[c] = 0
        closer = far < near
        near[closer], owner[closer] = far[closer], len(centres)
        centres.append(c)
        if not todo and (out := np.flatnonzero(near > r * r)).size:
            todo.append(int(out[0]))
    return centres, owner, near


class CoverTree:
    """Nodes as arrays: centre (a point), radius (to the farthest point below), members, children."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm = x, np.sqrt(np.einsum("ij,ij->i", x, x))
        self.unit = directions(x)
        self.small = self.unit.astype(np.float32)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        todo = [self._node(0, np.arange(len(x)))]
        while todo:
            node = todo.pop()
            own, below = self.members[node], []
            r = self.radius[node] / 2
            at = int(np.flatnonzero(own == self.centre[node])[0])
            while len(own) > LEAF and r > EDGE and not below:
                found = net(self.unit[own], [at], r, CENTRES)
                if found is None:
                    break
                centres, owner, _ = found
                if len(centres) > 1:
                    below = [self._node(int(own[c]), own[owner == k]) for k, c in enumerate(centres)]
                r /= 2
            self.children[node] = np.array(below, np.int64)
            todo += below

    def _node(self, centre: int, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(np.maximum(0, 2 - 2 * (self.unit[members] @ self.unit[centre])).max())) + EDGE if len(members) > 1 else 0.0)
        self.members.append(members)
        self.children.append(np.empty(0, np.int64))
        return len(self.centre) - 1


def close_pairs(a: CoverTree, b: CoverTree, m: np.ndarray, n: np.ndarray, own: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points m of a and n of b whose cosine is at least the threshold; own: each pair of m once, and none with itself."""
    slack = 6e-8 * (a.x.shape[1] + 8)

    def exact(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norm[p] * b.norm[q]) >= cosine

    for at in range(0, len(m), STRIP):
        p = m[at : at + STRIP]
        q = n[at:] if own else n
        maybe = a.small[p] @ b.small[q].T >= cosine - slack
        if own:
            maybe &= p[:, None] < q[None, :]
        i, j = np.nonzero(maybe)
        if len(i) * 20 > maybe.size:
            value = a.unit[p] @ b.unit[q].T
            near = maybe & (value >= cosine)
            i, j = np.nonzero(maybe & (np.abs(value - cosine) < 1e-12))
            near[i, j] = exact(p[i], q[j])
            i, j = np.nonzero(near)
        elif len(i):
            keep = exact(p[i], q[j])
            i, j = i[keep], j[keep]
        if len(i):
            yield p[i], q[j]


def links(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point the weight of the points it links with, and a root for each that is the same for all that links connect.

    With a is b these are the points of a, and no point links with itself; else those of a, then those of b.
    """
    same, reach = a is b, np.sqrt(max(0.0, 2 - 2 * cosine))
    shift = 0 if same else len(a.x)
    count = np.zeros(len(a.x) + (0 if same else len(b.x)), np.int64)
    root = np.arange(len(count))

    def join(p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(count, p, weight_b[q])
        np.add.at(count, q + shift, weight_a[p])
        hooked(root, p, q + shift)

    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        m, n = a.members[i], b.members[j]
        own = same and i == j
        apart = float(np.sqrt(((a.unit[a.centre[i]] - b.unit[b.centre[j]]) ** 2).sum()))
        if not own and apart > reach + a.radius[i] + b.radius[j] + EDGE:
            continue
        if own and 2 * a.radius[i] <= reach - EDGE:
            count[m] += weight_a[m].sum() - weight_a[m]
            hooked(root, m, np.full(len(m), a.centre[i]))
        elif not own and apart + a.radius[i] + b.radius[j] <= reach - EDGE:
            count[m] += weight_b[n].sum()
            count[n + shift] += weight_a[m].sum()
            hooked(root, m, np.full(len(m), b.centre[j] + shift))
            hooked(root, n + shift, np.full(len(n), a.centre[i]))
        elif len(a.children[i]) or len(b.children[j]):
            p = a.children[i] if len(a.children[i]) else np.array([i])
            q = b.children[j] if len(b.children[j]) else np.array([j])
            stack += [(int(u), int(v)) for u in p for v in q if not own or u <= v]
        else:
            for p, q in close_pairs(a, b, m, n, own, cosine):
                join(p, q)
    return count, root


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding, label) -> the same with a row number and, where the vector can link, its dimension, a digest and its values as bytes.

    Values are scaled by a power of two, so that no square overflows or vanishes.
    """
    part, count = TaskContext.get().partitionId(), 0
    for b in batches:
        rows = []
        for i, v, label in zip(b.column("vec_id").to_pylist(), b.column("embedding"), b.column("label").to_pylist(), strict=True):
            x = v.values.to_numpy(zero_copy_only=False).astype(float) if v.is_valid and v.values.null_count == 0 else np.zeros(0)
            fit = i is not None and label is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            if fit:
                scaled = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
                rows.append(((part << 33) + count, i, label, len(x), hashlib.sha256((x + 0.0).tobytes()).digest(), scaled.astype("<f8").tobytes()))
            else:
                rows.append(((part << 33) + count, i, label, None, None, None))
            count += 1
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["row", "vec_id", "label", "dim", "digest", "x"])


def _members(rows: pa.Table | pa.RecordBatch) -> dict[tuple[str, int], pa.Array]:
    """The places of the rows of each label and dimension."""
    out: dict[tuple[str, int], list[int]] = {}
    for k, name in enumerate(zip(rows.column("label").to_pylist(), rows.column("dim").to_pylist(), strict=True)):
        out.setdefault(name, []).append(k)
    return {name: pa.array(at) for name, at in out.items()}


def upper_levels(points: DataFrame, block: int) -> Nets:
    """The last upper level's centres, for the largest labels that fill more than a block: of a sample with bounds on rows, labels and bytes."""
    large = points.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block).orderBy(F.desc("n"), "label", "dim").limit(LABELS).collect()
    if not large:
        return {}
    each = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * max(r.dim for r in large))) // len(large))
    shares = points.sparkSession.createDataFrame([(r.label, r.dim, min(1.0, each / r.n)) for r in large], "label string, dim int, share double")
    drawn = points.join(F.broadcast(shares), ["label", "dim"])  # LABELS rows at most
    sample = drawn.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("label", "dim", "x").toArrow()
    of = _members(sample)
    found: Nets = {}
    for r in large:
        own = of.get((r.label, r.dim))
        if own is None:
            continue
        unit, centres, radius = directions(matrix(sample.column("x").take(own), r.dim)), [0], 1.0
        while radius > EDGE and (level := net(unit, centres, radius, CELLS)):
            centres, radius = level[0], radius / 2
        found[(r.label, r.dim)] = unit[centres]
    return found


def _placed(nets: Nets) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Points -> the same with the nearest centre of their label and the distance from it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, place = np.zeros(len(b), np.int32), np.zeros(len(b))
            for name, own in _members(b).items():
                if name in nets:
                    near = directions(matrix(b.column("x").take(own), name[1])) @ nets[name].T
                    at = own.to_numpy()
                    cell[at], place[at] = near.argmax(axis=1), np.sqrt(np.maximum(0, 2 - 2 * near.max(axis=1)))
            yield pa.record_batch([*b.columns, pa.array(cell), pa.array(place)], names=[*b.schema.names, "cell", "place"])

    return of


def _blocks(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Points sorted by label, dimension, cell and place -> the same with their block; the first of a block has its bounds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, run in numbered(batches, ["label", "dim", "cell"], rows):
            unit = directions(matrix(run.column("x"), run.column("dim")[0].as_py()))
            centre, place, n = unit.mean(axis=0), run.column("place").to_numpy(), len(run)
            bounds = {"centre": centre.tolist(), "radius": float(np.sqrt(((unit - centre) ** 2).sum(axis=1).max())), "low": float(place.min()), "high": float(place.max())}
            out = run.append_column("block", pa.array(np.full(n, block)))
            for k, v in bounds.items():
                out = out.append_column(k, pa.array([v, *[None] * (n - 1)], pa.list_(pa.float64()) if k == "centre" else pa.float64()))
            yield from out.combine_chunks().to_batches()

    return of


def _traverse(cosine: float, in_task: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by task: a block's points (turn -1), then those of the blocks that it meets -> (rep, weight of links, a rep that links connect it with)."""

    def told(reps: np.ndarray, count: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        linked = np.flatnonzero(count)
        return pa.record_batch([pa.array(reps[linked]), pa.array(count[linked]), pa.array(reps[root[linked]])], names=["rep", "n", "other"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["block", "slice", "turn"]):
            tree = CoverTree(matrix(run.column("x"), run.column("dim")[0].as_py()))
            reps, weight = run.column("rep").to_numpy(), run.column("weight").to_numpy()
            if run.column("turn")[0].as_py() == -1:
                first, first_reps, first_weight = tree, reps, weight
                if run.column("block")[0].as_py() // in_task == run.column("slice")[0].as_py():
                    yield told(reps, *links(tree, tree, weight, weight, cosine))
            else:
                yield told(np.concatenate([first_reps, reps]), *links(first, tree, first_weight, weight, cosine))

    return of


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98, block: int = 4096, in_task: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of embeddings (vec_id, embedding, label).

    Vectors of equal, non-null label and dimension link when their cosine in double precision is at least `cosine`.
    Vectors that are null, empty or zero or hold a null or non-finite component link with nothing, nor do rows without a
    vec_id or label. Each row is a vector of its own: repeated rows link with each other. Other columns are ignored. An
    empty table gives an empty result.

    A task holds a block of up to `block` points and up to `in_task` others, one at a time; long vectors make smaller blocks.
    """
    return settled(embeddings.sparkSession, "near-vectors", lambda: _near_duplicates(embeddings, cosine, block, in_task))


def _near_duplicates(embeddings: DataFrame, cosine: float, block: int, in_task: int) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    read = written(rows.mapInArrow(_read, "row long, vec_id long, label string, dim int, digest binary, x binary"), "vectors")
    fit = read.where("digest is not null").groupBy("label", "dim", "digest")
    classes = written(fit.agg(F.min("row").alias("rep"), F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("x").alias("x")), "points")
    points = classes.select("label", "dim", "rep", "weight", "x")
    block = fitting(block, points.agg(F.max("dim")).first()[0] or 1)
    shape = "label string, dim int, rep long, weight long, x binary, cell int, place double"
    order = ("label", "dim", "cell", "place", "rep")
    placed = points.mapInArrow(_placed(upper_levels(points, block)), shape).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(placed.mapInArrow(_blocks(block), shape + ", block long, centre array<double>, radius double, low double, high double"), "blocks")
    bounds = written(blocks.where("centre is not null").select("block", "label", "dim", "cell", "centre", "radius", "low", "high"), "bounds")
    pairs = written(_met(bounds, float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6).withColumn("slice", F.floor(F.col("other") / in_task)), "pairs")
    columns = ("block", "slice", "turn", "dim", "rep", "weight", "x")
    vectors = blocks.select("block", "dim", "rep", "weight", "x")
    held = vectors.join(pairs.select("block", "slice").distinct(), "block").withColumn("turn", F.lit(-1).cast("long"))
    passing = vectors.withColumnRenamed("block", "other").join(pairs.where("block <> other"), "other").withColumn("turn", F.col("other"))
    task = held.select(*columns).unionByName(passing.select(*columns)).repartition("block", "slice").sortWithinPartitions("block", "slice", "turn", "rep")
    found = written(task.mapInArrow(_traverse(cosine, in_task), "rep long, n long, other long"), "links")
    of = components(found.select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = classes.select("label", "dim", "digest", "rep", "weight", "least").join(counts, "rep", "left").join(of.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = written(per_class.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    known = written(per_class.join(lowest, "component").select("label", "dim", "digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component_id"), "classes")
    return read.select("vec_id", "label", "dim", "digest").join(known, ["label", "dim", "digest"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _met(bounds: DataFrame, reach: float) -> DataFrame:
    """Pairs (block, other) of blocks that may have links, each pair once and each block with itself, dealt over salts so that no task pairs all of a label."""
    spread = min(256, 1 + bounds.count() // 64)
    one = bounds.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(spread)))
    two = bounds.select(F.col("block").alias("other"), "label", "dim", *[F.col(c).alias(f"other_{c}") for c in ("cell", "centre", "radius", "low", "high")])
    two = two.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "other_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    gap = F.greatest(F.col("low") - F.col("other_high"), F.col("other_low") - F.col("high"))
    near = ((F.col("cell") != F.col("other_cell")) | (gap <= reach)) & (apart <= F.col("radius") + F.col("other_radius") + reach)
    return one.join(two, ["label", "dim", "salt"]).where((F.col("block") <= F.col("other")) & near).select("block", "other")
