"""Divergence of sources from each other and from their language, by hash-consed segment trees.

Each source of a language counts the language's terms. Over term ids, numbered from the most frequent term on, a source's
counts are a segment tree whose equal subtrees are one node. Two trees are priced by going down both at once; a pair of
nodes met again is priced once, and stands for all places where both occur. As most terms are rare, most of the trees are
a few nodes. Ids are cut into blocks, subtrees of a language that tasks price by themselves; the sums over blocks are the
prices of the whole trees.

All arithmetic is exact: probabilities are whole parts of SCALE, found by long division in base 1000.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.shared import settled, written
from lakemart.operators.numbering import numbered

LEAST_DOCS = 3
TOP = 200
#: A count's probability is 1 + floor(SCALE * (count + 1) / (all counts + terms)), SCALE being DIGITS digits in base BASE.
BASE, DIGITS = 1000, 3
#: Terms of a block and numbers of a block's counts (terms times sources), at most.
WIDTH, CELLS = 1 << 12, 1 << 20
HELD = 1 << 19
CHUNK = 1 << 22
#: ASCII letters are terms, in lower case, and so are all bytes of longer characters; the rest are breaks.
LETTERS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """A text's terms, a part of a long one at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(LETTERS)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= CHUNK else data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) -> (lang, source, term, n, docs), summed over as many rows as fit in memory; a null term names its group."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for group, own in n.items():
            for part in ([(None, 0, 0)], [(t, c, docs[group][t]) for t, c in own.items()]):
                term, count, within = zip(*part, strict=True) if part else ((), (), ())
                named = [pa.array([g] * len(term), pa.string()) for g in group]
                yield pa.record_batch([*named, pa.array(term, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(within, pa.int64())], names=["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for b in batches:
        for k, (lang, source) in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)):
            seen: set[bytes] = set()
            counts = n[lang, source]
            for words in terms(b.column("text")[k].as_py()):
                counts.update(words)
                seen.update(words)
            docs[lang, source].update(seen)
            if k % 256 == 255 and sum(map(len, n.values())) > HELD:
                yield from out()
    yield from out()


def divided(a: Column, b: Column) -> Column:
    """The whole part of a quotient of longs."""
    return F.call_function("div", a, b)


def share(x: Column, whole: Column) -> Column:
    """1 + floor(BASE^DIGITS * x / whole), x at most whole, by long division: no product is past BASE * whole."""
    out, rest = F.lit(0).cast("long"), x
    for _ in range(DIGITS):
        out, rest = out * BASE + divided(rest * BASE, whole), (rest * BASE) % whole
    return out + 1


def shares(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """As share."""
    out, rest = np.zeros(len(x), np.int64), x
    for _ in range(DIGITS):
        digit, rest = np.divmod(rest * BASE, whole)
        out = out * BASE + digit
    return out + 1


class Trees:
    """Hash-consed segment trees over rows of counts, of 2^depth columns: equal subtrees, of any rows and places, are one node.

    A leaf is a count, and -1 is no term. children[l] has the two nodes below each node of level l + 1.
    """

    def __init__(self, counts: np.ndarray):
        self.values, at = np.unique(counts, return_inverse=True)
        at, nodes = at.reshape(counts.shape), len(self.values)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while at.shape[1] > 1:
            pairs, up = np.unique(at[:, ::2] * nodes + at[:, 1::2], return_inverse=True)
            self.children.append((pairs // nodes, pairs % nodes))
            at, nodes = up.reshape(len(at), -1), len(pairs)
        self.root = at[:, 0]

    def priced(self, a: np.ndarray, b: np.ndarray, totals: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
        """Of trees a[k] and b[k]: the sums over their terms of (p - q)^2 / q and of (p - q)^2 / p, p of a and q of b.

        Both trees are gone through at once, all pairs k level by level; each pair of nodes is priced once a k.
        """
        pair, x, y, ways = np.arange(len(a)), self.root[a], self.root[b], []
        for left, right in reversed(self.children):
            n = int(max(left.max(), right.max())) + 1
            below = [(pair * n + side[x]) * n + side[y] for side in (left, right)]
            met, way = np.unique(np.concatenate(below), return_inverse=True)
            ways.append(way)
            pair, x, y = met // (n * n), met // n % n, met % n
        own, other = self.values[x], self.values[y]
        real = own >= 0
        p, q = shares(np.where(real, own, 0) + 1, totals[a[pair]] + kept), shares(np.where(real, other, 0) + 1, totals[b[pair]] + kept)
        apart = (p - q) ** 2
        forth, back = np.where(real, apart // q, 0), np.where(real, apart // p, 0)
        for way in reversed(ways):
            half = len(way) // 2
            forth, back = forth[way[:half]] + forth[way[half:]], back[way[:half]] + back[way[half:]]
        return forth, back


def _priced(rows: pa.Table) -> pa.Table:
    """A block's rows (lang, block, width, source, slot, n, total, kept), of each source at least one -> (lang, source, item, value), both ways."""
    first = rows.slice(0, 1).to_pylist()[0]
    lang, width, kept = first["lang"], first["width"], first["kept"]
    named = rows.column("source").combine_chunks().dictionary_encode()
    names, at = named.dictionary.to_pylist(), named.indices.to_numpy()
    slot, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
    totals = np.zeros(len(names), np.int64)
    totals[at] = rows.column("total").to_numpy()
    counts = np.zeros((len(names), width), np.int64)
    counts[:, max(0, min(width, kept - first["block"] * width)) :] = -1
    has = n > 0
    counts[at[has], slot[has]] = n[has]
    trees = Trees(counts)
    pairs = np.array(list(combinations(range(len(names)), 2)), np.int64).reshape(-1, 2)
    step, out = max(1, CELLS // width), []
    for k in range(0, len(pairs), step):
        a, b = pairs[k : k + step].T
        forth, back = trees.priced(a, b, totals, kept)
        out += [(a, b, forth), (b, a, back)]
    a, b, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), (), ())))
    text = pa.array(names, pa.string())
    return pa.table([pa.array([lang] * len(a), pa.string()), text.take(pa.array(a)), text.take(pa.array(b)), pa.array(value)], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of docs (text, lang, source) is from others and from its language.

    Terms are runs of ASCII letters, in lower case, and of characters beyond ASCII. A language keeps the terms of
    `least_docs` of its documents or more, V in all. A group, which is a source of a language or the whole language,
    gives each kept term p = 1 + floor(10^9 * (count + 1) / (its counts of kept terms + V)). Part `pair`: the sum over
    all kept terms of floor((p - q)^2 / q), q of each other source of the language. Part `term`: the same of each kept
    term that the source has and favours (p > q, q of the language), the `top` greatest. Ranks start at 1 per group and
    part, by value descending, then item.

    Null texts, languages and sources count as empty ones; sources without terms take part with counts of 0, and V = 0
    gives pairs of value 0. Each row is a document, repeated or not. Other columns are ignored. An empty table gives an
    empty result. Exact while counts stay under 9 * 10^15.
    """
    return settled(docs.sparkSession, "divergence", lambda: _audit(docs, least_docs, top))


def _audit(docs: DataFrame, least_docs: int, top: int) -> DataFrame:
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts", compression="zstd")
    known = counts.where("term is not null")
    vocabulary = known.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "lang_n")
    vocabulary = numbered(vocabulary, ["lang", F.desc("lang_n"), "term"], "number")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"), F.min("number").alias("first"))
    kept = written(known.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "number"), "kept-counts", compression="zstd")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total", "first")])
    groups = written(groups, "groups")  # a row a group
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    # A block is a power of two of terms, and fewer where there are many sources.
    fit = F.pow(F.lit(2.0), F.floor(F.log2(F.lit(float(CELLS)) / F.greatest(F.lit(1), F.col("sources")))))
    groups = groups.join(sources, "lang").withColumn("width", F.greatest(F.lit(1), F.least(F.lit(WIDTH), fit.cast("int"))))

    held = kept.join(groups, ["lang", "source"])
    at = F.col("number") - F.col("first")
    cells = held.select("lang", divided(at, F.col("width").cast("long")).alias("block"), "width", "source", (at % F.col("width")).cast("int").alias("slot"), "n", "total", "kept")
    # Every source has its tree in every block of its language, of counts of 0 if need be.
    last = divided(F.col("kept") - 1, F.col("width").cast("long"))
    empty = groups.where("kept > 0").select("lang", F.explode(F.sequence(zero, last)).alias("block"), "width", "source", F.lit(0).alias("slot"), zero.alias("n"), "total", "kept")
    sums = cells.unionByName(empty).groupBy("lang", "block").applyInArrow(_priced, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("kept = 0")
    others = bare.select("lang", F.col("source").alias("item"))
    pairs = pairs.unionByName(bare.select("lang", "source").join(others, "lang").where("source <> item").withColumn("value", zero))

    p, q = share(F.col("n") + 1, F.col("total") + F.col("kept")), share(F.col("lang_n") + 1, F.col("lang_total") + F.col("kept"))
    favoured = held.where("n > 0").select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    favoured = favoured.select("lang", "source", "item", divided((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [t.withColumn("rank", place).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, t in (("pair", pairs), ("term", favoured))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
