"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are sequences of words, and two are near-duplicates when one edit at most (a word put in, left out or replaced)
turns one into the other. A line's variants are itself and what is left when any one word is deleted, as hashed keys.
Two lines of n words are one replacement apart exactly when they give the same variant by deleting the same place, and
lines of n and n - 1 words are one edit apart exactly when a variant of the longer is the shorter itself. So the lines
of one (variant, place) are all near each other, and the earliest of them stands for all: no pairs are made of a group.
Lines of under five words have no variants, as one edit may change their sense: of those only exact repeats go.

Only lines that can have a partner get variants. If two lines are one edit apart, they agree on one of two halves; a
line whose four half keys are met in no other line is left out beforehand, without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.shared import settled, written

MIN_WORDS = 5
CHUNK = 1 << 20
SPACES = b" \t\n\r\x0b\x0c"
_random = np.random.default_rng(20)
BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
BASE = int(_random.integers(0, 1 << 63)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)
SALT = _random.integers(0, 1 << 64, 8, np.uint64)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.isin(np.arange(256), list(SPACES))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k for k < n, modulo 2^64."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _tables.update(up=_powers(BASE, size), down=_powers(INVERSE, size))
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lines:
    """Lines of some texts, as hashes of their words: row, number (place in the text), n words, start in `words`."""

    def __init__(self, segments: list[tuple[int, int, bytes]], least: int):
        data = np.frombuffer(b"\n".join(x for _, _, x in segments) + b"\n", np.uint8)
        up, down = powers(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[_lower[data]] * up[: len(data)], dtype=np.uint64)])
        space = _space[data]
        before = np.concatenate([[True], space[:-1]])
        first, last = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        self.words = mix((sums[last] - sums[first]) * down[first])
        line = np.concatenate([[0], np.cumsum(data == 10)])
        in_line = line[first]
        sizes = np.array([len(x) for _, _, x in segments], np.int64) + 1
        opens = line[np.cumsum(sizes) - sizes]  # the first line of each segment
        kept, start, n = np.unique(in_line, return_index=True, return_counts=True)
        full = n >= least
        kept, self.start, self.n = kept[full], start[full], n[full]
        segment = np.searchsorted(opens, kept, "right") - 1
        self.row = np.array([r for r, _, _ in segments], np.int64)[segment]
        self.number = kept - opens[segment] + np.array([k for _, k, _ in segments], np.int64)[segment]
        place = np.arange(len(self.words)) - np.repeat(start, n)
        up, _ = powers(int(n.max(initial=0)) + 2)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.words * up[place], dtype=np.uint64)])

    def prefix(self, k: np.ndarray) -> np.ndarray:
        """Hash of each line's first k words."""
        return self.sums[self.start + k] - self.sums[self.start]

    def suffix(self, k: np.ndarray) -> np.ndarray:
        """Hash of each line's last k words."""
        return (self.sums[self.start + self.n] - self.sums[self.start + self.n - k]) * powers(int(self.n.max(initial=0)) + 2)[1][self.n - k]

    @property
    def ids(self) -> np.ndarray:
        return mix(self.prefix(self.n) ^ SALT[0])

    def half_keys(self) -> list[np.ndarray]:
        """Of lines of n words as the longer (N = n) and as the shorter (N = n + 1) of a pair: N's first and last half."""
        out = []
        for length in (self.n, self.n + 1):
            salt = mix(length.astype(np.uint64))
            out += [mix(self.prefix(length // 2) ^ salt ^ SALT[1]), mix(self.suffix(length - length // 2) ^ salt ^ SALT[2])]
        return out

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, role, key): role 0 by replaced place, 1 by what is left, 2 of the line itself."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(line)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        at = self.start[line] + place
        _, down = powers(2)
        left = self.sums[at] - self.sums[self.start[line]] + (self.sums[(self.start + self.n)[line]] - self.sums[at + 1]) * down[1]
        by_place = mix(left ^ mix(place.astype(np.uint64) ^ SALT[3]))
        whole = self.prefix(self.n)
        roles = np.repeat(np.array([0, 1, 2], np.int8), [len(line), len(line), len(whole)])
        return np.concatenate([line, line, np.arange(len(whole))]), roles, np.concatenate([by_place, mix(left ^ SALT[4]), mix(whole ^ SALT[4])])


def segments_of(texts: pa.Array) -> Iterator[list[tuple[int, int, bytes]]]:
    """Whole lines of some texts at a time: (row, number of the first line, bytes)."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, x in enumerate(texts):
        data = (x.as_py() or "").encode("utf-8", "surrogatepass")
        at = number = 0
        while at <= len(data):
            end = len(data) if len(data) - at <= CHUNK else data.find(b"\n", at + CHUNK)
            end = len(data) if end < 0 else end
            held.append((row, number, data[at:end]))
            size += end - at + 1
            number += data.count(b"\n", at, end) + 1
            at = end + 1
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _indexed(least: int):
    """Rows -> their lines that have words, with half keys if they have `least` words or more."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held in segments_of(b.column("text")):
                x = Lines(held, 1)
                halves = [pa.array(k.view(np.int64), mask=x.n < least) for k in x.half_keys()]
                cols = [b.column("doc_id").take(pa.array(x.row)), pa.array(x.number.astype(np.int32)), _longs(x.ids), *halves]
                yield pa.record_batch(cols, names=["doc_id", "number", "line", "k0", "k1", "k2", "k3"])

    return of


def _varied(least: int):
    """Rows (doc_id, text, wanted lines) -> each wanted line's variants, and on one of its rows its words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = [{(y["number"], y["line"]) for y in x} for x in b.column("wanted").to_pylist()]
            for held in segments_of(b.column("text")):
                x = Lines(held, least)
                ids = x.ids.view(np.int64)
                mine = np.array([(a, c) in wanted[r] for r, a, c in zip(x.row.tolist(), x.number.tolist(), ids.tolist(), strict=True)], bool)
                x.row, x.number, x.n, x.start, ids = x.row[mine], x.number[mine], x.n[mine], x.start[mine], ids[mine]
                line, role, key = x.variants()
                words = np.full(len(line), None, object)
                words[role == 2] = [x.words[s : s + n].tobytes() for s, n in zip(x.start.tolist(), x.n.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(ids[line]), b.column("doc_id").take(pa.array(x.row[line])), pa.array(x.number[line].astype(np.int32)), pa.array(role), _longs(key), pa.array(words, pa.binary())],
                    names=["line", "doc_id", "number", "role", "key", "words"],
                )

    return of


def one_edit(a: bytes, b: bytes) -> bool:
    """Are these sequences of 64-bit words at most one edit apart?"""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > 1:
        return False
    k = len(y)
    ahead = int(np.argmin(np.append(x[:k] == y, False)))
    behind = int(np.argmin(np.append((x[len(x) - k :] == y)[::-1], False)))
    return ahead + behind >= len(x) - 1


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["line"]).filter(pa.array([one_edit(x.as_py(), y.as_py()) for x, y in zip(b.column("words"), b.column("other"), strict=True)], pa.bool_()))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, dropped): per document that loses lines, an array of (number, line): place from 0 and hash of each, ascending.

    The order is that of doc_id, then place. A line goes if an earlier line of any document equals it or, both having
    `min_words` words or more, is one edit away, whether that one stays or not. Words are split at ASCII white space, and
    A-Z count as a-z; lines without words always stay. Rows without a text or a doc_id take no part. Rows equal in doc_id
    and text are one document and are treated alike; of rows equal in doc_id alone, each line has its own place. An empty
    table gives an empty result.
    """
    return settled(docs.sparkSession, "dropped-lines", lambda: _dropped_lines(docs, min_words), compression="zstd")


def _dropped_lines(docs: DataFrame, min_words: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    seen = written(rows.mapInArrow(_indexed(max(1, min_words)), f"doc_id {kind}, number int, line long, k0 long, k1 long, k2 long, k3 long"), "lines")
    firsts = written(
        seen.groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("times"), *[F.min(k).alias(k) for k in ("k0", "k1", "k2", "k3")]),
        "first-lines",
    )
    keys = firsts.select("line", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).where("key is not null")
    # What is joined by a key that may be crowded is written first: then either side of the join is a shuffle of its own,
    # which adaptive plans can split.
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-halves")
    near = keys.join(shared, "key").select("line").distinct()
    wanted = firsts.join(near, "line").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.number").alias("number"), "line")).alias("wanted"))
    varied = written(
        rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_varied(min_words), f"line long, doc_id {kind}, number int, role byte, key long, words binary"),
        "variants",
        compression="zstd",
    )
    place = F.struct("doc_id", "number", "line")
    earliest = [F.min(F.when(F.col("role") == k, place)).alias(f"e{k}") for k in range(3)]
    groups = written(varied.groupBy("key").agg(*earliest, F.count("*").alias("n")).where("n > 1"), "variant-groups")
    met = varied.join(groups, "key").select("line", place.alias("own"), F.when(F.col("role") == 0, F.col("e0")).when(F.col("role") == 1, F.col("e2")).otherwise(F.col("e1")).alias("other"))
    pairs = met.where("other < own and other.line <> line").groupBy("line").agg(F.min("other").alias("other")).select("line", F.col("other.line").alias("of"))
    words = written(varied.where("role = 2").groupBy("line").agg(F.first("words").alias("words")), "line-words", compression="zstd")
    both = pairs.join(words, "line").join(words.select(F.col("line").alias("of"), F.col("words").alias("other")), "of")
    far = both.select("line", "words", "other").mapInArrow(_verified, "line long").withColumn("goes", F.lit(True))
    told = written(firsts.join(far, "line", "left").where("goes or times > 1").select("line", "first", F.coalesce("goes", F.lit(False)).alias("goes")), "told-lines")
    gone = seen.select("doc_id", "number", "line").join(told, "line").where(F.col("goes") | (F.struct("doc_id", "number") != F.col("first")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("number", "line"))).alias("dropped"))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) per row of docs: dropped has the places of the lines that go, joined by commas.

    A null text has no line. See dropped_lines for what goes.
    """
    text = F.col("text").cast("string")
    counts = docs.select("doc_id", F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"))
    gone = dropped_lines(docs, min_words)
    out = counts.join(gone, "doc_id", "left")
    return out.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("dropped", lambda x: x["number"].cast("string")), ","), F.lit("")).alias("dropped"),
    )


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with the text of each document less its dropped lines. A text that is null or loses nothing is unchanged.

    See dropped_lines for what goes.
    """
    gone = dropped_lines(docs, min_words).select(F.col("doc_id").alias("id"), F.array_distinct(F.transform("dropped", lambda x: x["number"])).alias("gone"))
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def kept(lines: Column) -> Column:
        """What lies between one dropped line and the next, joined: the lines are gone through once."""
        ends = F.concat("gone", F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), F.col("gone")), ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))), "\n")

    less = F.transform(F.array(F.split(F.col("row.text"), "\n", -1)), kept)[0]  # split once, not once a stretch
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(less)
    return rows.join(gone, "id", "left").select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
