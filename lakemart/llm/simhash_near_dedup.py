"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits; two documents link when theirs differ in at most `radius` bits. Covering masks
make the search exact: bit i carries a nonzero vector phi(i) of radius + 1 bits, and table v (each nonzero v) keys on the
bits whose phi has an odd inner product with v. The vectors of at most `radius` differing bits span a proper subspace, so
some v is orthogonal to them all and the pair agrees on that table's whole key. 2^(radius+1) - 1 tables miss no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.shared import components, one_of_each, settled, written

BITS = 64
SEED = 42
SLICE = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of the XXH64 of all word shingles, as an unsigned integer; no words: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        stop = np.cumsum(lengths + 1) - 1
        starts, ends = (stop - lengths)[: 1 - words or None].tolist(), stop[words - 1 :].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), SLICE):
        part = list(zip(starts[k : k + SLICE], ends[k : k + SLICE], strict=True))
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions such that any `radius` of them are all outside one mask."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << p for k, p in enumerate(positions) if ((k % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long, from the whole text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in b.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of, f"doc_id {kind}, fp long")


def _links(radius: int):
    """Rows with a list of fingerprints of one bucket -> edges of a spanning forest of its links."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, dst = [], []
            for x in b.column("fps"):
                fp = np.unique(np.array(x.values.to_numpy(zero_copy_only=False), np.int64))
                near = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= radius
                left = near.sum(axis=1) > 1
                while left.any():
                    wave = np.zeros(len(fp), bool)
                    wave[first := int(np.argmax(left))] = True
                    left[first] = False
                    while wave.any():
                        found = np.argmax(near & wave[:, None], axis=0)  # for each, a member of the wave that it links with
                        wave = near[wave].any(axis=0) & left
                        left &= ~wave
                        src += fp[found[wave]].tolist()
                        dst += fp[wave].tolist()
            yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return of


def fingerprint_links(fps: DataFrame, radius: int = 3, bucket: int = 256) -> DataFrame:
    """Edges (src, dst) that connect all of the distinct fingerprints (column fp) within `radius` bits of each other.

    A bucket of up to `bucket` fingerprints is compared whole. A larger one is keyed again, with covering masks over the
    bits its key leaves out, until it is small enough: once 8 bits are left, it can't hold over 256. So no group is cut
    short, and none is compared whole if it is large.
    """
    masks = {0: covering_masks(list(range(BITS)), radius)}
    members = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    found = []
    while masks:
        finer = F.create_map(*[x for a, ms in masks.items() for x in (F.lit(_signed(a)), F.array(*[F.lit(_signed(a | m)) for m in ms]))])
        keys = members.select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        if found:
            keys = keys.distinct()
        counts = written(keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        small = keys.join(counts.where(F.col("n") <= bucket), ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(small.select("fps").mapInArrow(_links(radius), "src long, dst long"))
        large = counts.where(F.col("n") > bucket)
        used = [r.mask & (2**64 - 1) for r in large.select("mask").distinct().collect()]  # at most one row a mask
        masks = {a: covering_masks([p for p in range(BITS) if not a >> p & 1], radius) for a in used}
        if masks:
            members = written(keys.join(large, ["mask", "key"]).select("fp", "mask"), "members")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    Null and wordless texts have fingerprint zero and link like any other. Fewer than `words` words are one shingle.
    Rows of equal fingerprint are one class, so copies are never paired; component_id is the smallest doc_id reachable.
    Repeated rows give repeated results. A null doc_id is kept and is never a component_id unless all ids of its component are null.
    Other columns are ignored. An empty table gives an empty result.
    """
    return settled(docs.sparkSession, "near-documents", lambda: _near_duplicates(docs, words, radius))


def _near_duplicates(docs: DataFrame, words: int, radius: int) -> DataFrame:
    fps = written(fingerprints(docs, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = components(fingerprint_links(classes, radius)).select(F.col("node").alias("fp"), "component")
    rooted = classes.join(linked, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = rooted.join(lowest, "component").select("fp", "component_id")
    return fps.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one of the smallest doc_id.

    Of rows that repeat a doc_id one stays: see one_of_each, also for nulls. An empty table gives an empty result.
    """
    kept = near_duplicates(docs, words, radius).where("doc_id = component_id").select("doc_id").distinct()
    return one_of_each(docs, kept)
