"""Repeated passages, found by difference-cover anchors.

COVER is a difference cover modulo PERIOD: for any two places there is one shift, under PERIOD, that takes both to places
in the cover. So two equal windows, wherever they begin, hold an anchor (ANCHOR words from a place in the cover) at the
same distance from their starts, and only anchors are hashed of every text. Where an anchor is met again, the windows
around it are extended to their whole length and judged: the earliest of equal windows stays.

Anchors and windows that are met again within the texts of one task are told there; of each, one goes on. So what is
gathered by a key is a row a task's stretch of text, however many copies there are, and no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.line_dedup import BYTE, mix, powers
from lakemart.llm.shared import settled, written

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
CHUNK, STRETCH = 1 << 20, 1 << 22
_random = np.random.default_rng(13)
FACTOR = _random.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
SALT = _random.integers(0, 1 << 63, 3, np.uint64)
_space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, part) of the words of some parts of texts; none spans two parts."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)])
    space = _space[data]
    before = np.concatenate([[True], space[:-1]])
    first, last = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    ends = np.cumsum([len(x) + 1 for x in parts])
    return mix((sums[last] - sums[first]) * down[first]), np.searchsorted(ends, first, "right")


def stretches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hash and row of each word): whole texts of about STRETCH bytes at a time."""
    words: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    parts: list[bytes] = []
    owner: list[int] = []
    begin, size, held = 0, 0, 0

    def put() -> None:
        nonlocal held
        if parts:
            h, part = hashed(parts)
            words.append(h)
            rows.append(np.array(owner, np.int64)[part])
            parts.clear()
            owner.clear()
        held = 0

    for row, x in enumerate(texts):
        data = (x.as_py() or "").encode("utf-8", "surrogatepass")
        at = 0
        while at < len(data):
            end = at + CHUNK
            while end < len(data) and not _space[data[end]]:
                end += 1
            parts.append(data[at:end])
            owner.append(row)
            held += len(parts[-1])
            at = end
            if held >= CHUNK:
                put()
        size += len(data)
        if size >= STRETCH or row == len(texts) - 1:
            put()
            yield begin, row + 1, np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *rows])
            words, rows, begin, size = [], [], row + 1, 0


def places(row: np.ndarray) -> np.ndarray:
    """Each word's place in its text, of words in order."""
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    return np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else np.zeros(0, np.int64)


def windows(words: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of `length` words from each place on, by one of two independent families."""
    out = np.zeros(len(at), np.uint64)
    for j in range(length):
        own = words[at + j]
        out += (mix(own ^ SALT[2]) if which else own) * FACTOR[which, j]
    return mix(out ^ SALT[which])


def inside(row: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of places, those from which `length` words of one text follow."""
    at = at[at + length <= len(row)]
    return at[row[at + length - 1] == row[at]]


def _anchored(window: int):
    """Rows (key, text) -> (h, key, at): an anchor's hash and place. One met before in the stretch has a hash of its own, and ~place."""
    length = window - PERIOD + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            for _, _, words, row in stretches(b.column("text")):
                place = places(row)
                at = inside(row, np.flatnonzero(np.isin(place % PERIOD, COVER)), length)
                h = windows(words, at, length)
                _, first, way, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                again = times[way] > 1
                lone = again & (first[way] != np.arange(len(at)))
                own, p = key[row[at]], place[at]
                h[lone] = mix(mix(own[lone].view(np.uint64)) + p[lone].astype(np.uint64))
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(own), pa.array(np.where(again, ~p, p).astype(np.int32))], names=["h", "key", "at"])

    return of


def kept(text: str | None, starts: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """(words, words removed, the rest joined by single spaces) of a text whose windows at these places go."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    if not len(starts):
        return len(tokens), 0, b" ".join(tokens)
    edge = np.zeros(len(tokens) + 1, np.int64)
    starts = np.unique(starts)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    stays = np.cumsum(edge[:-1]) == 0
    return len(tokens), int((~stays).sum()), b" ".join(compress(tokens, stays.tolist()))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, parts[0].dtype if parts else np.int64), *parts])).cast(kind))


def _finished(told: list[tuple[int, int, bytes]], digest: bool) -> list[pa.Array]:
    """n_words, n_removed, and the kept words or their SHA-256."""
    n, gone, rest = zip(*told, strict=True) if told else ((), (), ())
    return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() if digest else x.decode("utf-8", "surrogatepass") for x in rest], pa.string())]


def _extended(window: int, digest: bool):
    """Rows with the places of their repeated anchors -> finished ones, and open ones: their text, the starts that are
    known to go, and of each other distinct window around an anchor its hashes g and g2 and its start."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            for begin, end, words, row in stretches(b.column("text")):
                ids = b.column("doc_id").slice(begin, end - begin).to_pylist()
                found = b.column("anchors").slice(begin, end - begin).to_pylist()
                first, last = np.searchsorted(row, np.arange(begin, end)), np.searchsorted(row, np.arange(begin, end), "right")
                wanted = np.zeros(len(words), bool)
                for k, own in enumerate(found):
                    if own:
                        p = np.array(own, np.int64)
                        p = np.where(p < 0, ~p, p)[:, None] - np.arange(PERIOD)
                        wanted[first[k] + p[(p >= 0) & (p + window <= last[k] - first[k])]] = True
                at = np.flatnonzero(wanted)
                g, g2 = windows(words, at, window), (windows(words, at, window, 1) >> np.uint64(32)).astype(np.uint32)
                # The order of the documents; rows equal in doc_id and text are one document.
                own = [(x, y) for x, y in zip(ids, key[begin:end].tolist(), strict=True)]
                order = {x: k for k, x in enumerate(sorted({x for x in own if x[0] is not None}))}
                rank = np.array([order.get(x, -1) for x in own], np.int64)[row[at] - begin] if len(at) else np.zeros(0, np.int64)
                start = at - first[row[at] - begin] if len(at) else at
                by = np.lexsort((start, rank, g2, g))
                head = np.ones(len(by), bool)
                head[1:] = (g[by[1:]] != g[by[:-1]]) | (g2[by[1:]] != g2[by[:-1]])
                lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))] if len(by) else by
                goes, stays = np.zeros(len(at), bool), np.zeros(len(at), bool)
                goes[by] = (rank[by] != rank[lead]) | (start[by] != start[lead])
                stays[by[head]] = True
                cut = np.searchsorted(at, [*first, len(words)])
                pieces = [slice(x, y) for x, y in zip(cut, cut[1:], strict=False)]
                texts = b.column("text").slice(begin, end - begin)
                # A row with anchors is open; whether copies of its windows are elsewhere is still to be told.
                opened = np.array([s.stop > s.start for s in pieces], bool)
                told = [(0, 0, b"") if o else kept(t.as_py(), (), window) for o, t in zip(opened.tolist(), texts, strict=True)]
                shut = [pa.array(opened), *_finished(told, digest)]
                lists = [
                    _lists([start[s][goes[s]] for s in pieces], pa.int32()),
                    _lists([g[s][stays[s]].view(np.int64) for s in pieces], pa.int64()),
                    _lists([g2[s][stays[s]].view(np.int32) for s in pieces], pa.int32()),
                    _lists([start[s][stays[s]] for s in pieces], pa.int32()),
                ]
                text = pa.array([t.as_py() if o else None for o, t in zip(opened.tolist(), texts, strict=True)], pa.string())
                yield pa.record_batch(
                    [b.column("doc_id").slice(begin, end - begin), b.column("key").slice(begin, end - begin), *shut, text, *lists],
                    names=["doc_id", "key", "open", "n_words", "n_removed", "kept", "text", "known", "g", "g2", "start"],
                )

    return of


def _closed(window: int, digest: bool):
    """Open rows with all starts that go -> finished ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                some = b.slice(k, 256)
                starts = [np.array([*x, *(y or ())], np.int64) for x, y in zip(some.column("known").to_pylist(), some.column("gone").to_pylist(), strict=True)]
                told = [kept(t.as_py(), s, window) for t, s in zip(some.column("text"), starts, strict=True)]
                yield pa.record_batch([some.column("doc_id"), *_finished(told, digest)], names=["doc_id", "n_words", "n_removed", "kept"])

    return of


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of docs (doc_id, text): kept is the text without repeated passages.

    Words are what stands between ASCII white space, unchanged. Each word goes that is in a window of `window` words of
    one text whose words, in order, are also those of a window that starts earlier: in a document of a smaller doc_id, or
    earlier in the same. Windows are judged on the input. What stays is joined by single spaces; digest: kept is the
    lower-case hexadecimal SHA-256 of that. `window` may be PERIOD to 256.

    A null text has no words. Rows without a doc_id have no place in the order: they lose nothing, and nothing is lost to
    them. Rows equal in doc_id and text are one document and lose the same; of rows equal in doc_id alone, the order is
    that of a hash of the text. Other columns are ignored. An empty table gives an empty result.
    """
    if not PERIOD <= window <= FACTOR.shape[1]:
        raise ValueError(f"a window has {PERIOD} to {FACTOR.shape[1]} words")
    return settled(docs.sparkSession, "without-repeats", lambda: _dedup(docs, window, digest))


def _dedup(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    # Rows without a doc_id meet nothing in the joins below, and each has a key of its own so that they spread.
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", text))
    rows = docs.select("doc_id", key.alias("key"), text.alias("text"))
    anchors = rows.where("doc_id is not null and text is not null").select("key", "text").mapInArrow(_anchored(window), "h long, key long, at int")
    times = F.count("*").over(Window.partitionBy("h"))
    again = anchors.withColumn("n", times).where("n > 1 or at < 0").groupBy("key").agg(F.collect_set("at").alias("anchors"))
    again = written(again, "anchors", compression="zstd")  # so that adaptive plans can split rows that repeat one document
    finished = "n_words long, n_removed long, kept string"
    shape = f"doc_id {kind}, key long, open boolean, {finished}, text string, known array<int>, g array<long>, g2 array<int>, start array<int>"
    judged = written(rows.join(again, "key", "left").select("doc_id", "key", "text", F.when(F.col("doc_id").isNotNull(), F.col("anchors")).alias("anchors")).mapInArrow(_extended(window, digest), shape), "windows", compression="zstd")
    found = judged.where("open").select("doc_id", "key", F.explode(F.arrays_zip("g", "g2", "start")).alias("w")).select("doc_id", "key", "w.*")
    own = F.struct("doc_id", "key", "start")
    later = found.withColumn("first", F.min(own).over(Window.partitionBy("g", "g2"))).where(own != F.col("first"))
    gone = written(later.groupBy("doc_id", "key").agg(F.collect_set("start").alias("gone")), "later-windows", compression="zstd")
    last = judged.where("open").select("doc_id", "key", "text", "known").join(gone, ["doc_id", "key"], "left")
    closed = last.mapInArrow(_closed(window, digest), f"doc_id {kind}, {finished}")
    return judged.where("not open").select("doc_id", "n_words", "n_removed", "kept").unionByName(closed)
