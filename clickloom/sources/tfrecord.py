"""TFRecord source and sink (gzip files of Example messages) as a Spark data source.

Register with ``spark.dataSource.register(TFRecordDataSource)`` and use
``spark.read.format("tfrecord").schema(...).load(dir)`` and
``df.write.format("tfrecord").mode("overwrite").save(dir)``.

One file is one partition: gzip files cannot be split.
"""

from __future__ import annotations

import posixpath
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_type

from clickloom.session import ship_package

BATCH = 4096
GRID_BYTES = 1 << 26


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a plain path or a URI."""
    if ":" not in path.split("/", 1)[0]:
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _gzip_files(fs: pafs.FileSystem, root: str) -> list[str]:
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [root]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [i.path for i in found if i.type == pafs.FileType.File and i.path.endswith(".gz")]
    return sorted(n for n in names if not posixpath.basename(n).startswith((".", "_")))


# --- record framing: length, masked CRC-32C of the length, bytes, masked CRC-32C of the bytes ---
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):  # reflected Castagnoli polynomial
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def masked_crcs(records: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of many byte strings, one byte position of all at a time."""
    lengths = np.array([len(r) for r in records], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(records), dtype=np.uint32)
    start = 0
    while start < len(order):  # longest first, in groups that fit the byte grid
        width = int(lengths[order[start]])
        group = order[start : start + max(1, GRID_BYTES // max(width, 1))]
        grid = np.zeros((width, len(group)), dtype=np.uint8)
        for column, i in enumerate(group):
            grid[: lengths[i], column] = np.frombuffer(records[i], dtype=np.uint8)
        alive = np.searchsorted(-lengths[group], -np.arange(width), side="left")
        crc = np.full(len(group), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(width):
            n = alive[at]
            crc[:n] = _TABLE[(crc[:n] ^ grid[at, :n]) & 0xFF] ^ (crc[:n] >> 8)
        crc = ~crc
        out[group] = ((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)
        start += len(group)
    return out


def frame(records: list[bytes]) -> bytes:
    heads = [struct.pack("<Q", len(r)) for r in records]
    head_crcs, crcs = masked_crcs(heads), masked_crcs(records)
    return b"".join(
        h + struct.pack("<I", hc) + r + struct.pack("<I", c)
        for h, hc, r, c in zip(heads, head_crcs.tolist(), records, crcs.tolist())
    )


def unframe(stream, verify: bool = True):
    """Yield lists of up to ``BATCH`` records."""
    heads, records, crcs = [], [], []

    def checked():
        if verify and (
            (masked_crcs([h[:8] for h in heads]) != [struct.unpack("<I", h[8:])[0] for h in heads]).any()
            or (masked_crcs(records) != crcs).any()
        ):
            raise ValueError("damaged record: checksum does not match")
        return records

    while True:
        head = stream.read(12)
        if not head:
            break
        if len(head) < 12:
            raise ValueError("damaged record: file ends inside a header")
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4)
        if len(body) < n + 4:
            raise ValueError("damaged record: file ends inside a record")
        heads.append(head)
        records.append(body[:n])
        crcs.append(struct.unpack("<I", body[n:])[0])
        if len(records) == BATCH:
            yield checked()
            heads, records, crcs = [], [], []
    if records:
        yield checked()


# --- Example message: features { map name -> bytes_list=1 | float_list=2 | int64_list=3 } ---
def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append((n & 0x7F) | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _chunk(tag: int, data: bytes) -> bytes:
    return bytes([tag << 3 | 2]) + _varint(len(data)) + data


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _chunks(buf: bytes):
    """(tag, wire type, value) of every part of a message."""
    at = 0
    while at < len(buf):
        key, at = _read_varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = _read_varint(buf, at)
        elif kind == 2:
            n, at = _read_varint(buf, at)
            value, at = buf[at : at + n], at + n
        elif kind == 5:
            value, at = buf[at : at + 4], at + 4
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        else:
            raise ValueError(f"damaged message: wire type {kind}")
        yield key >> 3, kind, value


def _feature_kind(t: T.DataType) -> str:
    e = t.elementType if isinstance(t, T.ArrayType) else t
    if isinstance(e, (T.StringType, T.BinaryType)):
        return "bytes"
    if isinstance(e, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(e, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)):
        return "int"
    raise ValueError(f"type {t.simpleString()} cannot be stored in an Example")


def encode_value(kind: str, values: list) -> bytes:
    if kind == "bytes":
        return _chunk(1, b"".join(_chunk(1, v.encode() if isinstance(v, str) else v) for v in values))
    if kind == "float":
        return _chunk(2, _chunk(1, struct.pack(f"<{len(values)}f", *values)) if values else b"")
    return _chunk(3, _chunk(1, b"".join(_varint(int(v)) for v in values)) if values else b"")


def decode_value(buf: bytes) -> list:
    out: list = []
    for tag, _, body in _chunks(buf):
        for _, kind, value in _chunks(body):
            if tag == 1:
                out.append(value)
            elif tag == 2:
                out += struct.unpack(f"<{len(value) // 4}f", value)
            elif kind == 0:
                out.append(value - (1 << 64) if value >> 63 else value)
            else:
                at = 0
                while at < len(value):
                    v, at = _read_varint(value, at)
                    out.append(v - (1 << 64) if v >> 63 else v)
    return out


def encode_batch(batch: pa.RecordBatch, schema: T.StructType) -> list[bytes]:
    """One message per row; every distinct value of a column is encoded once per batch."""
    parts: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
    for f, column in zip(schema.fields, batch.columns):
        kind, many, name = _feature_kind(f.dataType), isinstance(f.dataType, T.ArrayType), _chunk(1, f.name.encode())

        def entry(v):
            return b"" if v is None else _chunk(1, name + _chunk(2, encode_value(kind, v if many else [v])))

        if many:
            for row, v in zip(parts, column.to_pylist()):
                row.append(entry(v))
        else:
            coded = column.dictionary_encode()
            entries = [entry(v) for v in coded.dictionary.to_pylist()] + [b""]
            for row, i in zip(parts, coded.indices.fill_null(len(entries) - 1).to_pylist()):
                row.append(entries[i])
    return [_chunk(1, b"".join(row)) for row in parts]


def _decode_entry(entry: bytes) -> tuple[str, list]:
    name, value = "", b""
    for tag, _, v in _chunks(entry):
        if tag == 1:
            name = v.decode()
        else:
            value = v
    return name, decode_value(value)


def decode_record(record: bytes, known: dict[bytes, tuple[str, list]]) -> dict[str, list]:
    """``known`` remembers entries seen before: columns repeat their values a lot."""
    out = {}
    for _, _, features in _chunks(record):
        for _, _, entry in _chunks(features):
            pair = known.get(entry)
            if pair is None:
                pair = known[entry] = _decode_entry(entry)
            out[pair[0]] = pair[1]
    return out


_ARROW = {"bytes": pa.string(), "float": pa.float32(), "int": pa.int64()}


def _column(f: T.StructField, rows: list[dict], default) -> pa.Array:
    kind, many = _feature_kind(f.dataType), isinstance(f.dataType, T.ArrayType)
    values = []
    for row in rows:
        v = row.get(f.name)
        if v is None or (not many and not v):
            if many:
                v = []
            elif default is not None:
                v = [default]
            else:
                raise ValueError(f"record without a value for {f.name!r}, which has no default")
        if not many and len(v) != 1:
            raise ValueError(f"{len(v)} values for the scalar {f.name!r}")
        if kind == "bytes":
            v = [x.decode() if isinstance(x, bytes) else x for x in v]
        values.append(v if many else v[0])
    stored = pa.array(values, pa.list_(_ARROW[kind]) if many else _ARROW[kind])
    # integers are stored with 64 bits and narrowed to the declared width
    return stored.cast(to_arrow_type(f.dataType))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.options = schema, dict(options)

    def partitions(self):
        fs, root = _open(self.options["path"])
        names = _gzip_files(fs, root)
        if not names:
            raise FileNotFoundError(f"no TFRecord files below {root}")
        return [_File(n) for n in names]

    def read(self, partition):
        defaults = {
            f.name: self.options.get(f"default.{f.name}".lower(), self.options.get(f"default.{f.name}"))
            for f in self.schema.fields
        }
        for f in self.schema.fields:
            if defaults[f.name] is not None:
                cast = {"bytes": str, "float": float, "int": int}[_feature_kind(f.dataType)]
                defaults[f.name] = cast(defaults[f.name])
        verify = self.options.get("verify", "true").lower() != "false"
        names = [f.name for f in self.schema.fields]
        fs, _ = _open(self.options["path"])
        with fs.open_input_stream(partition.path, compression="gzip") as stream:
            for records in unframe(stream, verify):
                known: dict = {}
                rows = [decode_record(r, known) for r in records]
                columns = [_column(f, rows, defaults[f.name]) for f in self.schema.fields]
                yield pa.RecordBatch.from_arrays(columns, names=names)


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _Writer(DataSourceArrowWriter):
    """Tasks write hidden files; the commit gives the files of successful tasks their names."""

    def __init__(self, schema: T.StructType, options, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, dict(options)["path"], overwrite
        self.job = uuid.uuid4().hex
        for f in schema.fields:
            _feature_kind(f.dataType)

    def write(self, iterator):
        fs, root = _open(self.path)
        name, out = None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root)
                name = f"part-{uuid.uuid4().hex}.tfrecord.gz"
                out = fs.open_output_stream(f"{root}/.{self.job}-{name}", compression="gzip")
            for start in range(0, batch.num_rows, BATCH):
                out.write(frame(encode_batch(batch.slice(start, BATCH), self.schema)))
        if out is not None:
            out.close()
        return _Written(name)

    def commit(self, messages):
        fs, root = _open(self.path)
        fs.create_dir(root)
        if self.overwrite:
            for old in _gzip_files(fs, root):
                fs.delete_file(old)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{root}/.{self.job}-{m.name}", f"{root}/{m.name}")
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        fs, root = _open(self.path)
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if posixpath.basename(info.path).startswith(f".{self.job}-"):
                fs.delete_file(info.path)


class TFRecordDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tfrecord"

    def schema(self):
        raise ValueError("TFRecord files carry no schema: give one with .schema(...)")

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options, overwrite)


def register(spark) -> None:
    ship_package(spark)
    spark.dataSource.register(TFRecordDataSource)
