"""Web archives of pages, compressed with Zstandard, and a reader for them.

An archive starts with a skippable frame that holds a dictionary, followed by
one Zstandard frame per WARC record.  Archives are rows (name, content) of a
Parquet table: Spark's commit protocol then keeps each exactly once, also where
an executor is lost, and on every store.  The reader takes such rows from
anywhere, so Spark's ``binaryFile`` source feeds it archives that lie in files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import checked_broadcast, materialize, ship_package, table
from clickloom.plans.registry import Query
from clickloom.storage import new_path

# Fixed values of the formats
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: An archive is closed once its payloads reach this many bytes.
ARCHIVE_BYTES = 16 << 20
#: A dictionary of this many bytes is trained on the first payloads of an archive, up to as many bytes of them.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

_ARCHIVES = "name string, content binary"
_ARCHIVES_ARROW = pa.schema([("name", pa.string()), ("content", pa.binary())])
RECORDS = (
    "name string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, error string"
)
_RECORDS_ARROW = pa.schema([
    ("name", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
])
#: Records handed on at once by the reader.
BATCH_BYTES = 8 << 20


class Damaged(ValueError):
    """An archive or record that breaks the format."""


# writing


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest(), version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A WARC record whose block is an HTTP response; that of a revisit has the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", _base32(digest)),
        ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())),
        ("X-Page-Id", page_id),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to, digest) if revisit else None),
        ("X-Refers-To-Page-Id", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], samples: list[bytes], level: int = LEVEL) -> bytes:
    """The dictionary in a skippable frame, if the samples allow one, then a frame per record."""
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small samples
        packer, out = zstandard.ZstdCompressor(level=level, write_checksum=True), []
    else:
        packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
        stored = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
        out = [struct.pack("<II", SKIPPABLE, len(stored)), stored]
    return b"".join([*out, *map(packer.compress, records)])


def _write(size: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, samples, n, sampled = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{shard:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive(held, samples, level)], pa.binary())], schema=_ARCHIVES_ARROW)

        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page_id, url, payload, digest, refers_to in zip(*columns):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in (page_id, url, payload, digest, refers_to))
                held.append(record(page_id, url, payload, digest, refers_to, refers_to is not None))
                n += len(held[-1])
                if payload and sampled + len(payload) <= SAMPLE_BYTES and refers_to is None:
                    samples.append(payload)
                    sampled += len(payload)
                if n >= size:
                    yield close()
                    shard, held, samples, n, sampled = shard + 1, [], [], 0, 0
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, size: int = ARCHIVE_BYTES, level: int = LEVEL) -> None:
    """Archive every row of (page_id, url, html) below ``path``; a null html is an empty payload.

    Of equal payloads of at least ``revisit_bytes`` those with the largest
    page_id are responses (all of them, if rows share it), the others revisit it.
    A payload whose rows all lack a page_id has responses only.  A url keeps its
    characters but blanks and controls, which are written as %XX; a null url
    leaves its header out.  An empty table writes no archive.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).select("*", F.sha1("payload").alias("digest"), F.when(F.octet_length("payload") >= revisit_bytes, F.sha2("payload", 256)).alias("content_key"))
    copies = rows.where("content_key IS NOT NULL").groupBy("content_key").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    copies = materialize(copies.where("n > 1").select("content_key", "last"), "equal-payloads")
    known = rows.join(checked_broadcast(copies), "content_key", "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    known.select("page_id", "url", "payload", "digest", refers_to.alias("refers_to")).mapInArrow(_write(size, level), _ARCHIVES).write.parquet(path)


def export_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of its name into a folder that all executors have mounted."""

    def run(rows) -> None:
        import os

        for row in rows:
            part = f"{folder}/.{row.name}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, f"{folder}/{row.name}")  # whole or not at all, also when a task runs twice

    archives.foreachPartition(run)


# reading


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, by its header and block sizes alone."""
    flags = data[at + 4]
    at += 5 + (not flags >> 5 & 1) + (0, 1, 2, 4)[flags & 3]
    at += (flags >> 5 & 1, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if at > len(data):
            raise Damaged("the last frame is cut off")
        if block & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise Damaged("the last frame is cut off")
    return at


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of every frame of an archive, the dictionary of the leading frame applied."""
    data, at, unpack = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise Damaged("the last frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & ~0xF == SKIPPABLE & ~0xF:
            stored = bytes(data[at + 8 : at + 8 + size])
            if len(stored) < size:
                raise Damaged("the last frame is cut off")
            if at == 0 and magic == SKIPPABLE:
                if stored[:4] == struct.pack("<I", FRAME):
                    stored = unpack.decompressobj().decompress(stored)
                if stored[:4] != struct.pack("<I", DICTIONARY):
                    raise Damaged("the leading frame holds no dictionary")
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
            at += 8 + size
            continue
        if magic != FRAME:
            raise Damaged("no frame where one should start")
        end = frame_end(data, at)
        yield at, unpack.decompressobj().decompress(data[at:end])
        at = end


def _fields(head: bytes, first: str) -> tuple[str, dict[str, str]]:
    """The first line and the named fields, by lower-case name, of a block of header lines."""
    start, *lines = head.decode().split("\r\n")
    if not start.startswith(first):
        raise Damaged(f"no {first} line")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Damaged("a header line without a name")
        if name.lower() in fields:
            raise Damaged(f"{name} is given twice")
        fields[name.lower()] = value.strip(" \t")
    return start, fields


def _length(fields: dict[str, str], name: str = "content-length") -> int:
    if not fields.get(name, "").isdecimal():
        raise Damaged(f"no valid {name}")
    return int(fields[name])


def _digest(value: str, data: bytes | None = None) -> str:
    """The SHA-1 of a digest field in hex; must be that of ``data`` where given."""
    try:
        kind, _, text = value.partition(":")
        found = base64.b32decode(text) if kind == "sha1" else b""
    except ValueError:
        found = b""
    if len(found) != 20:
        raise Damaged("no valid digest")
    if data is not None and hashlib.sha1(data).digest() != found:
        raise Damaged("the digest is of other bytes")
    return found.hex()


def parse(raw: bytes) -> dict:
    """The fields of one record, its headers, lengths and digests validated."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise Damaged("the header has no end")
    _, fields = _fields(head, "WARC/1.")
    size, kind = _length(fields), fields.get("warc-type")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged(f"a block of {len(rest) - 4} bytes, announced {size}")
    if kind not in ("response", "revisit") or not all(fields.get(f) for f in ("warc-record-id", "warc-date")):
        raise Damaged("a needed field is missing")
    block = rest[:size]
    if "warc-block-digest" in fields:
        _digest(fields["warc-block-digest"], block)
    head, blank, payload = block.partition(b"\r\n\r\n")
    _, http = _fields(head, "HTTP/")
    payload_bytes = _length(http)
    if not blank or len(payload) != (0 if kind == "revisit" else payload_bytes):
        raise Damaged(f"a payload of {len(payload)} bytes, announced {payload_bytes}")
    refers_to = fields.get("x-refers-to-page-id")
    if (kind == "revisit") != (refers_to is not None and fields.get("warc-profile") == PROFILE):
        raise Damaged("what a revisit refers to is missing")
    page_id = fields.get("x-page-id")
    return {
        "page_id": None if page_id is None else int(page_id), "url": fields.get("warc-target-uri"), "payload_bytes": payload_bytes,
        "payload_digest": _digest(fields.get("warc-payload-digest", ""), payload if kind == "response" else None),
        "record_type": kind, "refers_to": None if refers_to is None else int(refers_to), "payload": payload if kind == "response" else None,
    }


def _read(name_column: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for name, content in zip(batch[name_column], batch["content"]):
                at, name = 0, name.as_py()
                found = frames(content.as_py() or b"")
                while True:
                    row = {"name": name, "offset": at}
                    try:
                        at, raw = next(found)
                        row |= {"offset": at} | parse(raw)
                    except StopIteration:
                        break
                    except (ValueError, zstandard.ZstdError) as e:  # a bad frame ends the archive, a bad record does not
                        row["error"] = str(e) or type(e).__name__
                    size += len(row.get("payload") or b"") if payloads else 200
                    held.append(row if payloads else row | {"payload": None})
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, _RECORDS_ARROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _RECORDS_ARROW)

    return run


def read_archives(archives: DataFrame, name: str = "name", payloads: bool = False) -> DataFrame:
    """Every record of the archives (``name``, content): RECORDS, without the payload unless asked for.

    ``error`` says what is wrong with a record or with the frame where reading an
    archive had to stop; its other fields are then null.  A revisit's length and
    digest are those of the payload it stands for; its payload is null.
    """
    ship_package(archives.sparkSession)
    return archives.select(F.col(name).alias("name"), "content").mapInArrow(_read("name", payloads), RECORDS)


def sound(records: DataFrame) -> DataFrame:
    """The records; fails on the first damaged one instead of losing it."""
    what = F.concat_ws(" ", "name", F.col("offset").cast("string"), "error")
    valid = F.when(F.col("error").isNotNull(), F.raise_error(what).cast("string")).otherwise(F.col("record_type"))
    return records.withColumn("record_type", valid)


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = sound(read_archives(spark.read.schema(_ARCHIVES).parquet(path)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, coalesce(html, '') AS payload,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), l AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM l
"""

QUERIES: dict[str, tuple[Query, str | None]] = {"op12_warc_archives": (op12_warc_archives, SQL)}
