"""WARC archives compressed by record with a dictionary that leads each file.

An archive is a `.warc.zst` file: a skippable frame that holds a Zstandard dictionary trained on records of that very
archive, then one independent frame per record. Any record can be read alone with the dictionary and its offset.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.shared import fresh_path, settled, written

DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long, dictionary_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    return None if urn.endswith(":none>") else int(urn[10:-1])


def _framed(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """The bytes of one response or revisit record; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(first))]
    return _framed(headers, http if revisit else http + payload)


def build_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on samples; of few samples, their own bytes are the dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _writer(directory: str, sample_bytes: int, dictionary_bytes: int, archive_bytes: int, level: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(directory)
        out = pack = path = None
        waiting: list[bytes] = []
        held = count = size = 0
        done: list[tuple] = []

        def flush() -> None:
            nonlocal out, pack, path, held, count, size
            if waiting and out is None:
                path = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
                made = build_dictionary(waiting, dictionary_bytes)
                pack = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
                out = fs.open_output_stream(path, compression=None)
                lead = struct.pack("<II", DICTIONARY_MAGIC, len(made.as_bytes())) + made.as_bytes()
                out.write(lead + pack.compress(_framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)], b"")))
                size, count = len(lead), 0
                done.append((path, 0, 0, len(lead) - 8))
            for x in waiting:
                frame = pack.compress(x)
                out.write(frame)
                size, count = size + len(frame), count + 1
            waiting.clear()
            held = 0
            if done:
                done[-1] = (path, count, size, done[-1][3])

        for b in batches:
            for page_id, url, payload, first, revisit in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "payload", "first", "revisit")), strict=True):
                waiting.append(x := record(page_id, url, payload, first, revisit))
                held += len(x)
                if held >= sample_bytes or out is not None:
                    flush()
                    if size >= archive_bytes:
                        out.close()
                        out = None
        flush()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "records", "bytes", "dictionary_bytes"), x, strict=True)) for x in done],
            pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("dictionary_bytes", pa.int64())]),
        )

    return of


def write_archives(pages: DataFrame, directory: str, sample_bytes: int = 1 << 20, dictionary_bytes: int = 1 << 16, archive_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """Write pages (page_id, url, html) as archives under directory; the manifest (path, records, bytes, dictionary_bytes).

    Each archive's dictionary is built from its own first `sample_bytes` of records; no record passes through the driver. A null html is an empty payload. Of rows with equal payloads those of the smallest page_id
    are responses (all of them, if rows repeat it) and others revisit it; null ids come last. A failed task's files are in
    no manifest. Other columns are ignored; an empty table writes no archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = written(rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "repeated")  # so that a crowded payload's join can be split
    told = rows.join(firsts, "sha", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)
    made = told.select("page_id", "url", "payload", "first", "revisit").mapInArrow(_writer(directory, sample_bytes, dictionary_bytes, archive_bytes, level), MANIFEST)
    return written(made, "manifest")


def records_of(raw: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, streamed."""
    magic, size = struct.unpack("<II", raw.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads this archive")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw.read(size)))
    stream = io.BufferedReader(unpack.stream_reader(raw, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("a record begins with something else than its version")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode().partition(":")
            headers[key] = value.removeprefix(" ")
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def _reader(directory: str, payloads: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(directory)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for h, block in records_of(raw):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        revisit = h["WARC-Type"] == "revisit"
                        if not revisit and (digest(body) != said or len(body) != length):
                            raise ValueError(f"{path}: the payload of {h['WARC-Record-ID']} is not what its record says")
                        rows.append(dict(zip(schema.names, (_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), length, said, h["WARC-Type"], _page(h["WARC-Refers-To"]) if revisit else None, body if payloads and not revisit else None), strict=True)))
                        held += len(body) * payloads + 200
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return of


def read_archives(manifest: DataFrame, directory: str, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, of responses, payload.

    One task reads one archive as a stream. Lengths and digests of responses are those of the bytes read back, which must
    equal what the record says.
    """
    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(tasks).mapInArrow(_reader(directory, payloads), RECORDS)


def round_trip(pages: DataFrame, **options: int) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page, as read back from archives in the shared folder.

    The archives are deleted once they are read. For nulls, repeated rows and empty tables see write_archives.
    """

    def read() -> DataFrame:
        directory = fresh_path(pages.sparkSession, "warc")
        return read_archives(write_archives(pages, directory, **options), directory, payloads=False).drop("url", "payload")

    return settled(pages.sparkSession, "records", read)
