"""JSON files that are one array of objects, read by many tasks.

Spark's multi-line reader gives a file to one task. Here files are cut at closing braces, which a text scan can do from
any byte on. Whether a brace ends a record depends on all before it: on quotes, and on how deep it is. So a first pass
tells of each block (a split of a file) how it changes both, for either state that it may begin in; a row a block is put
together file by file, and the second pass knows what each block begins in. Records that cross blocks are joined from
their parts. A file of a single block is known to begin between records; where all files are that small, one pass goes
through them, and no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A longer record is corrupt, and kept in parts: a lost quote costs no task more than this at a time.
RECORD_BYTES = 1 << 20
ESCAPE = re.compile(rb"\\.", re.S)
LEAD = re.compile(rb"[\s,\[\xef\xbb\xbf]*")
BETWEEN = re.compile(rb"[\s,\[\]\xef\xbb\xbf]*\Z")
LOW = -(1 << 60)
Block = tuple[str, int]
#: What is known of the block of a file that has no other, as `beginnings` tells it; how it ends is seen when it is read.
WHOLE_FILE = False, 0, True, None


def braces(piece: bytes) -> tuple[int, int, int]:
    """(quotes, opening braces between strings, opening braces within them) of a piece that begins between strings."""
    parts = (ESCAPE.sub(b"", piece) if b"\\" in piece else piece).split(b'"')
    if len(parts) == 1:
        return 0, piece.count(b"{"), 0
    return len(parts) - 1, sum(x.count(b"{") for x in parts[::2]), sum(x.count(b"{") for x in parts[1::2])


class State:
    """Where a scan is: within a string or not, and how many objects deep. A brace too many at depth 0 closes nothing."""

    def __init__(self, quoted: bool = False, depth: int = 0):
        self.quoted, self.depth = quoted, depth

    def take(self, piece: bytes, ended: bool = True) -> bool:
        """Go over a piece, and the brace that ends it; is a record complete then?"""
        quotes, outside, inside = braces(piece)
        self.depth += inside if self.quoted else outside
        self.quoted ^= bool(quotes % 2)
        if self.quoted or not ended:
            return False
        self.depth = max(0, self.depth - 1)
        return self.depth == 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Iterator[tuple[bytes, int, bool]]]]:
    """A partition's pieces block by block: (piece, the file's size, is it the block's last)."""

    def rows():
        for b in batches:
            yield from zip(b.column("path").to_pylist(), b.column("block").to_pylist(), b.column("size").to_pylist(), b.column("piece").to_pylist(), strict=True)

    source = rows()
    held = next(source, None)

    def block(own: Block) -> Iterator[tuple[bytes, int, bool]]:
        nonlocal held
        while held and held[:2] == own:
            _, _, size, piece = held
            held = next(source, None)
            yield piece, size, not (held and held[:2] == own)

    while held:
        own = held[:2]
        yield own, block(own)


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: does it turn the quoting, and how it changes the depth, d to max(d + gain, floor), begun between strings and within one."""
    out = []
    for (path, block), pieces in _blocks(batches):
        quoted, gain, floor, length = False, [0, 0], [LOW, LOW], 0
        for piece, size, _ in pieces:
            quotes, outside, inside = braces(piece)
            for start in (0, 1):
                within = quoted != bool(start)
                more = inside if within else outside
                gain[start], floor[start] = gain[start] + more, floor[start] + more
                if within == bool(quotes % 2):  # the closing brace is between strings
                    gain[start], floor[start] = gain[start] - 1, max(floor[start] - 1, 0)
            quoted ^= bool(quotes % 2)
            length += len(piece) + 1
        out.append({"path": path, "block": block, "size": size, "length": length, "turns": quoted, "gain0": gain[0], "floor0": floor[0], "gain1": gain[1], "floor1": floor[1]})
    yield pa.RecordBatch.from_pylist(out, SURVEY)


SURVEY = pa.schema([("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("turns", pa.bool_()), *[(f"{k}{s}", pa.int64()) for s in (0, 1) for k in ("gain", "floor")]])
SURVEY_DDL = "path string, block long, size long, length long, turns boolean, gain0 long, floor0 long, gain1 long, floor1 long"


def beginnings(survey: list[dict]) -> dict[Block, tuple[bool, int, bool, bool]]:
    """Of each block: (quoted, depth) at its start, whether it ends the file, and whether the file ends in something else than a brace."""
    out: dict[Block, tuple[bool, int, bool, bool]] = {}
    files: dict[str, list[dict]] = {}
    for r in survey:
        files.setdefault(r["path"], []).append(r)
    for path, blocks in files.items():
        blocks.sort(key=lambda r: r["block"])
        quoted, depth, open_end = False, 0, sum(r["length"] for r in blocks) > blocks[0]["size"]
        for r in blocks:
            out[path, r["block"]] = quoted, depth, r is blocks[-1], open_end
            way = "1" if quoted else "0"
            quoted, depth = quoted ^ r["turns"], max(depth + r["gain" + way], r["floor" + way])
    return out


def _recorded(shipped):
    """A row a record or part of one: what a block has before the end of the record that it begins in and after the last
    one that it ends is a part, of place 0 and 1; all else is whole, of place -1. So is all of a file that is one block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rows, size = shipped.value, [], 0
        for (path, block), pieces in _blocks(batches):
            quoted, depth, last, open_end = starts.get((path, block), WHOLE_FILE)
            state, held, length, place, cut, read = State(quoted, depth), [], 0, 0 if quoted or depth else -1, False, 0
            for piece, file_size, final in pieces:
                read += len(piece) + 1
                ended = not (final and last and (read > file_size if open_end is None else open_end))
                held.append(piece + b"}" * ended)
                length += len(piece) + 1
                done = state.take(piece, ended)
                if done or length > RECORD_BYTES:
                    rows.append((path, block, place, b"".join(held), done and not (cut and place < 0)))
                    size += length
                    held, length, place, cut = [], 0, -1 if done else place, not done
                if size > 1 << 22:
                    yield _batch(rows)
                    rows, size = [], 0
            if held:
                tail = -1 if open_end is None else 1 if place < 0 else 0
                rows.append((path, block, tail, b"".join(held), False))
                size += length
        yield _batch(rows)

    return of


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "block", "place", "text", "done"])


def _joined(parts: pa.Table) -> pa.Table:
    """A file's parts, in order, as the records that they make; what is left at its end is one as well, unless it only ends the array."""
    parts = parts.sort_by([("block", "ascending"), ("place", "ascending")])
    out, held, length, cut = [], [], 0, False
    for text, done in zip(parts.column("text").to_pylist(), parts.column("done").to_pylist(), strict=True):
        held.append(text)
        length += len(text)
        if done or length > RECORD_BYTES:
            out.append((b"".join(held), done and not cut))
            held, length, cut = [], 0, not done
    out.append((b"".join(held), False))
    path, (texts, sound) = parts.column("path")[0].as_py(), zip(*out, strict=True)
    return pa.table([pa.array([path] * len(out), pa.string()), pa.array(texts, pa.binary()), pa.array(sound, pa.bool_())], names=["path", "text", "done"])


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records without what stands before them; what only stands between records goes."""
    for b in batches:
        texts = b.column("text").to_pylist()
        keep = pa.array([not BETWEEN.match(x) for x in texts], pa.bool_())
        trimmed = pa.array([x[LEAD.match(x).end() :].decode("utf-8", "replace") for x in texts], pa.string())
        yield pa.record_batch([b.column("path"), trimmed, b.column("done")], names=["path", "text", "done"]).filter(keep)


def _may_be_split(spark: SparkSession, path: str) -> bool:
    """Is there a file that a scan may cut? By its size alone: no content is read, and a split is never smaller than this bound."""
    conf = spark._jsparkSession.sessionState().conf()
    bound = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())
    return (spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).first().n or 0) > bound


def read_json_array(spark: SparkSession, path: str, schema: str, corrupt: str = "_corrupt_record") -> DataFrame:
    """The objects of files that are arrays of them, one a row, by schema, and `_path`, the file that each is of.

    Rows are those of the multi-line reader where a file is sound, printed on one line or on many, or one object without
    an array. What can't be read costs itself alone: an object that does not fit the schema, a stretch that is no object
    and the end of a file that was cut off are rows with the text in `corrupt`, where the multi-line reader takes the
    whole file for corrupt. After a lost quote that is all up to the file's end. A file of nothing gives no row.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    meta = F.col("_metadata")
    pieces = pieces.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("piece"), (meta["file_block_length"] < meta["file_size"]).alias("split"))
    of_split = pieces.where("split").drop("split") if _may_be_split(spark, path) else None
    pieces = pieces.drop("split")
    survey = [] if of_split is None else [r.asDict() for r in of_split.mapInArrow(_surveyed, SURVEY_DDL).collect()]  # a row a block of a file that has several
    shipped = spark.sparkContext.broadcast(beginnings(survey))  # a few numbers a block
    shape = "path string, block long, place int, text binary, done boolean"
    texts = pieces.mapInArrow(_recorded(shipped), shape).where("place < 0").select("path", "text", "done")
    if of_split is not None:  # parts are what crosses a block's end: few, and gathered by file
        texts = texts.unionByName(of_split.mapInArrow(_recorded(shipped), shape).where("place >= 0").groupBy("path").applyInArrow(_joined, "path string, text binary, done boolean"))
    texts = texts.mapInArrow(_trimmed, "path string, text string, done boolean")
    row = F.from_json(F.when(F.col("done"), F.col("text")), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = texts.select(row.alias("row"), F.col("path").alias("_path"), F.when(~F.col("done"), F.col("text")).alias("_rest")).select("row.*", "_path", "_rest")
    return rows.withColumn(corrupt, F.coalesce(corrupt, "_rest")).drop("_rest")
