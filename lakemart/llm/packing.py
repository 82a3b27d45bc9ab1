"""Concatenate and cut: documents become token sequences of a fixed length.

All documents' tokens form one stream. Pass one tokenizes each document once and keeps its ids with its place in its
partition; prefix sums over the partitions' totals make that a place in the stream. Pass two cuts the stream into fixed
windows: a document that crosses a window's end leaves a boundary record on each side.
"""

from __future__ import annotations

import array
import codecs
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.shared import prefix_sums, settled, written

LENGTH = 4096
END = 2
WORDS_KEPT = 250_000
#: Bytes of the texts whose words are looked up at once.
BATCH = 2 << 20
MOST_STARTS = 1 << 19
#: Texts of these characters alone are split into words here; the tokenizer itself takes any other text.
OTHER = r"[^\x00-\x1b\x20-įı-ſ‐-‧‰-⁞]|<\|"
WORD = re.compile(r"[a-zªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼½¾]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9ªµºÀ-ÖØ-öø-ſ²³¹¼½¾]+")
#: By byte, the character that byte-level vocabularies write for it: the Latin-1 one of its number; those that don't print follow from 256 on.
_hidden = [*range(33), *range(127, 161), 173]
SHOWN = "".join(chr(256 + _hidden.index(b) if b in _hidden else b) for b in range(256))


#: How a tokenizers file says that it lower-cases and splits as WORD does, with byte-level words of their own.
LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class Known(dict):
    """What is known by word. `of` tells what isn't yet, and that is kept; nothing but the words asked for is gone through.

    Once WORDS_KEPT are known they step back to `before`. Those asked for again return from there; the rest goes when the next step back.
    """

    def __init__(self, of: Callable[[str], bytes]):
        super().__init__()
        self.of = of
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.pop(word, None)
        if found is None:
            found = self.of(word)
        self[word] = found
        return found

    def turn(self) -> None:
        if len(self) > WORDS_KEPT:
            self.before = dict(self)
            self.clear()


class WordTokenizer:
    """Ids of a tokenizer. If it is a lower-casing one whose words are independent, each word is encoded once and remembered, and so is what stands between white space."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.model = Tokenizer.from_file(vocabulary)
        self.merges = self.model.model
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        rules, split = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.independent = (
            rules.get("normalizers") == LOWERS and split[0] == SPLITS and len(split) == 2 and split[1].get("type") == "ByteLevel"
            and not split[1].get("add_prefix_space") and not split[1].get("use_regex") and spec["model"].get("type") == "BPE"
            and {x["content"][:2] for x in spec["added_tokens"]} <= {"<|"}
        )
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = self.kind.char
        self.packed = [self.pack([x]) for x in range(self.model.get_vocab_size())]
        self.words = Known(self.word)  # of no letters
        self.known = Known(self.between)  # between white space

    def pack(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()  # little-endian, as all machines that Spark runs on

    def word(self, word: str) -> bytes:
        shown = codecs.charmap_decode(word.encode(), "strict", SHOWN)[0]
        return b"".join([self.packed[x.id] for x in self.merges.tokenize(shown)])

    def between(self, space: str) -> bytes:
        """The ids of what stands between white space. Letters alone are one word, which is kept once, however it was met."""
        if space.isalpha():
            return self.word(space)
        return b"".join([(self.known if x.isalpha() else self.words)[x] for x in WORD.findall(space)])

    def looked_up(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts that are split here. What they have between white space is asked for once for all of them."""
        parts = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        met = parts.values.dictionary_encode()
        found = map(self.known.__getitem__, met.dictionary.to_numpy(zero_copy_only=False))
        ids = pa.array(list(found), pa.large_binary()).take(met.indices)
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        self.known.turn()
        self.words.turn()
        column = pa.array(texts, pa.large_string())
        other = pc.match_substring_regex(column, OTHER) if self.independent else pa.array([True] * len(texts), pa.bool_())
        ids = iter(self.looked_up(column.filter(pc.invert(other))))
        return [self.pack(self.model.encode(x, add_special_tokens=False).ids) if o else next(ids) for x, o in zip(texts, other.to_pylist(), strict=True)]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(vocabulary: str) -> WordTokenizer:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = WordTokenizer(vocabulary)
    return _loaded[vocabulary]


def _stretches(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive texts that together have about `most` bytes; a longer text is in a stretch of its own or begins one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(texts)]
    yield from ((a, b - a) for a, b in pairwise(cuts))


def _tokenized(vocabulary: str, end: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, start = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            for k, rows in _stretches(b.column("text"), BATCH):
                ids = [x + model.pack([end]) for x in model.encode([x or "" for x in b.column("text").slice(k, rows).to_pylist()])]
                n = np.array([len(x) // model.kind.itemsize for x in ids], np.int64)
                begin = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.record_batch(
                    [b.column("doc_id").slice(k, rows), pa.array([part] * len(ids), pa.int64()), pa.array(begin), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "begin", "n", "ids"],
                )

    return of


def _cut(length: int, with_ids: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for k, (begin, n, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("begin", "n", "ids")), strict=True)):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                place, cut = begin, 0
                while cut < n:
                    sequence, offset = divmod(place + cut, length)
                    piece = ids[cut : cut + length - offset]
                    at.append(k)
                    rows.append((cut, len(piece), zlib.crc32(piece.tobytes()), n, sequence, offset, *([piece.tobytes()] if with_ids else [])))
                    cut += len(piece)
            cols = list(zip(*rows, strict=True)) or [()] * (6 + with_ids)
            kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
            yield pa.record_batch([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return of


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of `length` tokens; the last sequence alone may be short.

    One row per piece: doc_id, start, length, ids_crc32 (of unsigned 32-bit little-endian ids), doc_tokens (with the end
    id), sequence_id, offset and, if asked for, ids (the same bytes). A null or empty text is the end id alone. Repeated
    rows and null ids are packed like any other. Other columns are ignored. An empty table gives an empty result.
    vocabulary is a tokenizers file, or the name of one of the public tokenizers that each executor has.
    """
    return settled(docs.sparkSession, "pieces", lambda: _pack(docs, vocabulary, length, end, with_ids), compression="zstd")


def _pack(docs: DataFrame, vocabulary: str, length: int, end: int, with_ids: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_tokenized(vocabulary, end), f"doc_id {kind}, part long, begin long, n long, ids binary")
    ids = written(ids, "tokens", compression="zstd")
    starts = prefix_sums(ids.groupBy("part").agg(F.sum("n").alias("n")), "part", "n").select("part", "start")
    if starts.count() <= MOST_STARTS:  # two numbers a partition
        starts = F.broadcast(starts)
    more = ", ids binary" if with_ids else ""
    placed = ids.join(starts, "part").select("doc_id", (F.col("start") + F.col("begin")).alias("begin"), "n", "ids")
    return placed.mapInArrow(_cut(length, with_ids), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{more}")
