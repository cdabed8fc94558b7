"""Token ids of a corpus in wavelet matrices, one compressed row of a file per shard of documents.

A shard holds whole documents in ascending doc_id order.  Its ids are numbered
by a sorted alphabet; bit-plane after bit-plane is stored with the ones counted
per block, which gives any token, the number of a token's occurrences in a
range, and the place of its k-th occurrence without unpacking the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import prepared, ship_package, table
from clickloom.llm.tokens import encoder
from clickloom.plans.registry import Query
from clickloom.storage import new_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: A shard is closed once it holds this many ids.
SHARD_TOKENS = 1 << 20
BLOCK = 512

SHARDS = (
    "part long, shard long, first_doc long, n_tokens long, doc_ids array<long>, ends array<long>, "
    "alphabet binary, zeros array<long>, planes array<binary>, ranks array<binary>"
)
_ARROW = pa.schema([
    ("part", pa.int64()), ("shard", pa.int64()), ("first_doc", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("alphabet", pa.binary()),
    ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


class WaveletMatrix:
    """Random access, counting and occurrence lookup over one shard's ids."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.alphabet, self.zeros = n, alphabet, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @staticmethod
    def build(ids: np.ndarray) -> "WaveletMatrix":
        if len(ids) and int(ids.max()) < 1 << 20:  # number the ids by a table, without sorting them
            alphabet = np.flatnonzero(np.bincount(ids))
            number = np.zeros(int(alphabet[-1]) + 1, np.uint32)
            number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
            codes = number[ids]
        else:
            alphabet, codes = np.unique(ids, return_inverse=True)
        codes = codes.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in reversed(range(max(1, int(len(alphabet) - 1).bit_length()))):
            ones = ((codes >> level) & 1).view(np.uint8)[:: codes.itemsize].view(bool)  # the lowest byte of each
            packed = np.packbits(ones, bitorder="little")
            filled = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            blocks = np.bitwise_count(filled.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(blocks)]).astype("<u4").tobytes())
            zeros.append(len(ones) - int(blocks.sum()))
            sorted_codes = np.empty_like(codes)
            codes.take(np.flatnonzero(~ones), out=sorted_codes[: zeros[-1]], mode="clip")
            codes.take(np.flatnonzero(ones), out=sorted_codes[zeros[-1] :], mode="clip")
            codes = sorted_codes
        return WaveletMatrix(len(ids), alphabet.astype("<u4"), zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (i + 7) // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        code = 0
        for level, zeros in enumerate(self.zeros):
            one = int(self.planes[level][i // 8] >> (i % 8)) & 1
            code, ones = 2 * code + one, self._ones(level, i)
            i = zeros + ones if one else i - ones
        return int(self.alphabet[code])

    def _walk(self, token: int, lo: int, hi: int) -> tuple[int, int, list[bool]] | None:
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        path, levels = [], len(self.zeros)
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            path.append(one := bool(code >> (levels - 1 - level) & 1))
            lo, hi = (zeros + a, zeros + b) if one else (lo - a, hi - b)
        return lo, hi, path

    def count(self, token: int, lo: int, hi: int) -> int:
        """Occurrences of a token in positions lo to hi-1."""
        at = self._walk(token, lo, hi)
        return at[1] - at[0] if at else 0

    def find(self, token: int, k: int) -> int | None:
        """Position of the k-th occurrence (from 0) of a token."""
        at = self._walk(token, 0, self.n)
        if at is None or not 0 <= k < at[1] - at[0]:
            return None
        i = at[0] + k
        for level in reversed(range(len(self.zeros))):
            one, zeros = at[2][level], self.zeros[level]
            i = self._select(level, one, i - zeros if one else i)
        return i

    def _select(self, level: int, one: bool, k: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def ids(self) -> np.ndarray:
        """All ids in order."""
        codes = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros, above = self.zeros[len(self.planes) - 1 - level], np.empty_like(codes)
            above[np.flatnonzero(~ones)], above[np.flatnonzero(ones)] = codes[:zeros], codes[zeros:] | codes.dtype.type(1 << level)
            codes = above
        return self.alphabet[codes]


def from_row(row: dict) -> WaveletMatrix:
    """The matrix of one row of the shard files."""
    return WaveletMatrix(row["n_tokens"], np.frombuffer(row["alphabet"], "<u4"), row["zeros"], row["planes"], row["ranks"])


def _shards(file: str, end_id: int, size: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard, docs, held, n = encoder(file), TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"))
            ends = np.cumsum([len(x) // 4 for x in held]).tolist()
            row = (part, shard, docs[0], m.n, docs, ends, m.alphabet.tobytes(), m.zeros, [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks])
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, row))], _ARROW)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                docs.append(doc_id)
                held.append(encode(text) + end)
                n += len(held[-1]) // 4
                if n >= size:
                    yield close()
                    shard, docs, held, n = shard + 1, [], [], 0
        if docs:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str, file: str = VOCABULARY, end_id: int = END_ID, size: int = SHARD_TOKENS) -> None:
    """Write the ids of all documents, ascending by doc_id, as shard files below ``path``.

    Rows with one doc_id are ordered by text; rows without one come first; null
    texts are empty (their end id alone); an empty table writes no shard.
    """
    ordered = prepared(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(file, end_id, size), SHARDS).write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = from_row(row).ids().tobytes()
            starts = [0, *row["ends"][:-1]]
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, row["ends"])]
            k = len(starts)
            yield pa.RecordBatch.from_pydict({
                "part": [row["part"]] * k, "shard": [row["shard"]] * k, "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "at": starts, "n_tokens": [b - a for a, b in zip(starts, row["ends"])], "ids_crc32": crcs,
            })


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shard files."""
    ship_package(spark)
    files = spark.read.schema(SHARDS).parquet(path)
    found = files.mapInArrow(_documents, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "shard", "first_doc", "n_tokens")
    # two steps: shards of a part, then one row a part
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.min(F.struct("first_doc", "part")).alias("order"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("order")) - F.col("n")).alias("part_start"))
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part")
    return found.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


QUERIES: dict[str, tuple[Query, str | None]] = {"op8_token_files": (op8_token_files, None)}
