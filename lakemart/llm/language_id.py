"""Language identification by bit-sliced Bloom filters of n-grams.

One filter serves all languages: each slot is a bitmask of languages. An n-gram's slots, and-ed, are the languages that
contain it. A text's popcounts per language, corrected for the filter's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
N = 5
SLOT_BITS = 20
PROBES = 3
CHUNK = 1 << 20
ROWS = 1024
#: Odd multipliers of the probes' hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: ASCII letters and all bytes of longer characters count as letters; the rest are breaks.
LETTER = np.array([b if b >= 128 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def ngrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of lower-case UTF-8 bytes as integers, and where each begins. Those of breaks at both ends are left out."""
    if len(data) < N:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    x = LETTER[data].astype(np.uint64)
    grams = np.zeros(len(x) - N + 1, np.uint64)
    for k in range(N):
        grams = (grams << np.uint64(8)) | x[k : len(x) - N + 1 + k]
    at = np.flatnonzero((x[: len(grams)] != 0x20) | (x[1 : len(grams) + 1] != 0x20))
    return grams[at], at


def slots(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams * np.uint64(f)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for f in FACTORS[:PROBES]]


def chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text bytes joined by breaks, each byte's row) of a string column, some rows or a part of a long one at a time."""
    held: list[bytes] = []
    rows: list[int] = []
    size = 0
    edge = b" "

    def out() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(held), np.uint8), np.repeat(rows, [len(x) for x in held])

    for i, x in enumerate(column):
        text = edge + (x.as_py() or "").lower().encode("utf-8", "surrogatepass") + edge
        for k in range(0, max(1, len(text) - N + 1), CHUNK):
            held.append(text[k : k + CHUNK + N - 1])
            rows.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                yield out()
                held, rows, size = [], [], 0
    if held:
        yield out()


def row_ngrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, row of each): none spans two rows."""
    for data, row in chunks(column):
        grams, at = ngrams(data)
        same = row[at] == row[at + N - 1]
        yield grams[same], row[at[same]]


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # (slots, words of 64 languages)

    @property
    def false_rates(self) -> np.ndarray:
        """Per language, the share of slots that have it, to the power of the probes."""
        return np.array([((self.masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() ** PROBES for k in range(len(self.languages))])


def learn(docs: DataFrame, docs_per_language: int = 2000, rate: float = 2e-5) -> LanguageFilter:
    """Learn from the whole texts of docs (text, lang): an n-gram belongs to a language if at least `rate` of its n-grams are that one.

    Rows without a text or a lang teach nothing. About `docs_per_language` rows of a language are used, drawn row by
    row, so that copies are drawn apart and no language vanishes; if a language has no more than that, all. An empty table
    gives a filter of no language. The filter has a fixed size, and the driver gets its slots alone.
    """
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return LanguageFilter([], np.zeros((1 << SLOT_BITS, 1), np.uint64))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_language / n))]), F.col("lang"))
    drawn = known.withColumn("draw", F.xxhash64("text", F.monotonically_increasing_id()))
    taught = drawn.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in set(langs):
                for grams, _ in row_ngrams(b.column("text").filter(pa.array(langs == lang))):
                    gram, n = np.unique(grams, return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    grams = taught.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {x: k for k, x in enumerate(languages)}
        for b in batches:
            gram, lang = b.column("gram").to_numpy().view(np.uint64), np.array([code[x] for x in b.column("lang").to_pylist()], np.int64)
            for at in slots(gram):
                yield pa.record_batch([pa.array(at), pa.array(lang // 64), pa.array(np.left_shift(np.uint64(1), (lang % 64).astype(np.uint64)).view(np.int64))], names=["slot", "word", "mask"])

    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    members = grams.join(F.broadcast(totals), "lang").where(F.col("n") >= rate * F.col("total"))  # one row a language
    found = members.select("lang", "gram").mapInArrow(placed, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((1 << SLOT_BITS, (len(languages) + 63) // 64), np.uint64)
    masks[found.column("slot").to_numpy(), found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return LanguageFilter(languages, masks)


def popcounts(column: pa.Array, masks: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: its number of n-grams, and the number of them that the filter gives for each language."""
    total, hits = np.zeros(len(column), np.int64), np.zeros((languages, len(column)), np.int64)
    for grams, row in row_ngrams(column):
        total += np.bincount(row, minlength=len(column))
        at = slots(grams)
        for word in range(masks.shape[1]):
            plane = np.ascontiguousarray(masks[:, word])
            seen = plane[at[0]]
            for x in at[1:]:
                seen &= plane[x]
            some = np.flatnonzero(seen)
            for k in range(word * 64, min(languages, word * 64 + 64)):
                has = some[(seen[some] >> np.uint64(k % 64)) & np.uint64(1) == 1]
                hits[k] += np.bincount(row[has], minlength=len(column))
    return total, hits


def _scored(docs: DataFrame, carried: Column, model: LanguageFilter, inside: bool) -> DataFrame:
    """(carried, lang_pred, score) per row; inside: the text is a field of what is carried, so it travels once."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        f = known.false_rates[:, None]
        for whole in batches:
            for k in range(0, len(whole), ROWS):
                b = whole.slice(k, ROWS)
                score, best = np.zeros(len(b)), np.zeros(len(b), np.int64)
                if known.languages:
                    text = pc.struct_field(b.column("carried"), "text") if inside else b.column("text")
                    total, hits = popcounts(text, known.masks, len(known.languages))
                    fair = np.clip((hits - total * f) / np.maximum(1e-9, 1 - f) / np.maximum(1, total), 0, 1)
                    best = fair.argmax(axis=0)
                    score = fair.max(axis=0)
                fit = np.array(b.column("letters").to_pylist(), bool) & bool(known.languages)
                names = np.array([*known.languages, UNKNOWN], object)[np.where(fit, best, len(known.languages))]
                yield pa.record_batch([b.column("carried"), pa.array(names, pa.string()), pa.array(np.where(fit, score, 0.0))], names=["carried", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(carried.alias("carried"), *([] if inside else [text.alias("text")]), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shape = T.StructType([rows.schema["carried"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(of, shape)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs' doc_id with lang_pred and score, from whole texts alone.

    score is the share of the text's n-grams that are the language's, corrected: of N n-grams a language that has none is
    given N * f by chance, f its false-positive rate. Equal scores go to the first language by name. A text that is null
    or has no letter is `und` with score 0; so is any, if the model knows no language. Other columns are ignored. Null
    and repeated ids are kept; an empty table gives an empty result.
    """
    return _scored(docs, F.col("doc_id"), model, False).withColumnRenamed("carried", "doc_id")


def held_out(doc_id: str = "doc_id"):
    """Documents that no model learns from: crc32 of the id's text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs (doc_id, text, lang); learned from rows that are not held out.

    Repeated rows give repeated results, and an empty table gives an empty one. For nulls see predict.
    """
    model = learn(docs.where(~held_out()), **options)
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.1, **options: float) -> DataFrame:
    """docs, all columns, of the rows whose language is known with a score of `least` or more; lang is then what was found.

    The model learns from docs' own text and lang. Repeated rows stay or go alike; an empty table stays empty. Text goes through the scorer beside the other columns, so nothing is joined.
    """
    text = {"text": F.col("text").cast("string").alias("text")}  # a struct of all columns, which has the text in it
    scored = _scored(docs, F.struct(*[text.get(c, F.col(f"`{c}`")) for c in docs.columns]), learn(docs, **options), True)
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("carried").getField(c).alias(c) for c in docs.columns])
