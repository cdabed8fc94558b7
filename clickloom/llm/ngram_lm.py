"""Stupid-backoff scores of whole texts under a bigram model counted over all documents.

Counts are relational: words and pairs are dealt out by hash, every partition
counts its own and answers for the documents that sent them, and a document's
answers are summed.  A pair goes to the partition of its first word, which so
knows both counts of the quotient; words with a ``HEAVY``-th of the corpus, at
most that many, are known everywhere, and their pairs go by the whole pair.
Pairs travel packed, one list per task and bucket.

A pair counts without the document's own occurrences.  Where no other document
has it, the score is ``BACKOFF`` times the share of the word in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import binary, exchange, freed, from_planes, keyed, materialize, partitions, planes, small_batches, table
from clickloom.llm.shingles import mix, word_hashes
from clickloom.plans.registry import Query

BACKOFF = 0.4
HEAVY = 10_000
#: Pairs that a task holds before it hands them on, and slices in which a partition is worked through.
HELD, SLICES = 150_000, 16
#: Texts taken out of an Arrow batch at once.
TEXTS = 256
START = np.uint64(1)
#: Stands for no document, in the counts of the corpus.
COUNT_ROW = -(1 << 62)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) >> np.uint64(32)) % np.uint64(buckets)


def _counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each value in that order, how many)."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(v)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(row, text), a few texts of a batch as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            yield from zip(part["row"].to_pylist(), binary(part["text"]))
        del batch
        pa.default_memory_pool().release_unused()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word, and how many of them end a text."""
    held, ends, n = [], [], 0

    def done() -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        last = np.zeros(len(words), np.int64)
        np.add.at(last, np.searchsorted(words, np.array(ends, np.uint64)), 1)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(last)], ["word", "n", "last"])

    for _, text in _texts(batches):
        words = word_hashes(text)
        if len(words):
            held.append(words)
            ends.append(words[-1])
            n += len(words)
        if n > 8 * HELD:
            yield done()
            held, ends, n = [], [], 0
    if held:
        yield done()


def document_pairs(text: bytes) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a text: (first word, second word, occurrences, occurrences of the first word as such)."""
    words = word_hashes(text)
    first = np.concatenate([[START], words[:-1]]) if len(words) else words
    key = mix(first) + words
    order, at, n = _counts(key)
    first, words = first[order][at], words[order][at]
    by, head, size = _counts(first)
    own = np.empty(len(first), np.int64)
    own[by] = np.repeat(np.add.reduceat(n[by], head) if len(head) else n, size)
    return first, words, n, own


def _pairs(heavy: np.ndarray, buckets: int):
    """Pairs by bucket, packed: those of one first word together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush() -> pa.RecordBatch:
            row, first, word, n, own = (np.concatenate(x) for x in zip(*held))
            key = np.where(np.isin(first, heavy), mix(first) + word, first)
            bucket = _bucket(key, buckets)
            order = np.lexsort((word, first, bucket))
            row, first, word, n, own, bucket = (x[order] for x in (row, first, word, n, own, bucket))
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            payload = []
            for a, b in zip(cuts, np.append(cuts[1:], len(row))):
                heads, sizes = np.unique(first[a:b], return_counts=True)
                parts = [heads.astype("<u8").tobytes(), sizes.astype("<u4").tobytes(), word[a:b].astype("<u8").tobytes(), planes(row[a:b]), planes(n[a:b]), planes(own[a:b])]
                payload.append(len(heads).to_bytes(4, "little") + b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(payload, pa.binary())], ["bucket", "payload"])

        for row, text in _texts(batches):
            first, word, n, own = document_pairs(text)
            if len(first):
                held.append((np.full(len(first), row, np.int64), first, word, n, own))
                n_held += len(first)
            if n_held >= HELD:
                yield flush()
                held, n_held = [], 0
        if held:
            yield flush()

    return run


def _part(payload: pa.Buffer, columns: int, words: bool, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """The heads from ``lo`` to below ``hi`` of a block, repeated by their sizes, and what goes with them."""
    raw = np.frombuffer(payload, np.uint8)  # read where it lies
    k, raw = int(raw[:4].copy().view("<u4")[0]), raw[4:]
    heads, sizes = raw[: 8 * k].copy().view("<u8"), raw[8 * k : 12 * k].copy().view("<u4").astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    i, j = np.searchsorted(heads, np.uint64(lo)), k if hi >> 64 else np.searchsorted(heads, np.uint64(hi))
    a, b, m, at = ends[i], ends[j], int(ends[-1]), 12 * k
    out = [np.repeat(heads[i:j], sizes[i:j])]
    if words:
        out.append(raw[at + 8 * a : at + 8 * b].copy().view("<u8"))
        at += 8 * m
    for _ in range(columns):
        out.append(from_planes(np.ascontiguousarray(raw[at : at + 8 * m].reshape(8, m)[:, a:b]).ravel()))
        at += 8 * m
    return tuple(out)


def _slices(batches: Iterator[pa.RecordBatch], columns: int, words: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """A partition's blocks, a slice of their heads at a time: packed they stay as they came, unpacked only one slice does."""
    payloads = [p.as_buffer() for batch in batches for p in batch["payload"]]
    for i in range(SLICES if payloads else 0):
        lo, hi = (i << 64) // SLICES, ((i + 1) << 64) // SLICES
        yield tuple(np.concatenate(x) for x in zip(*(_part(p, columns, words, lo, hi) for p in payloads)))


SCORED = "row long, score double, backed long, bucket int, payload binary"
_scored = pa.schema([("row", pa.int64()), ("score", pa.float64()), ("backed", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


class Sums:
    """Sums of scores and of pairs that backed off by document; handed on when there are many of them."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, row: np.ndarray, score: np.ndarray, backed: np.ndarray) -> None:
        if len(row):
            self.held.append(self._added([(row, score, backed)]))
        if sum(len(x[0]) for x in self.held[1:]) > HELD:
            self.held = [self._added(self.held)]

    @staticmethod
    def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        row, score, backed = (np.concatenate(x) for x in zip(*parts))
        order, first, _ = _counts(row)
        return row[order][first], np.add.reduceat(score[order], first), np.add.reduceat(backed[order], first)

    def rows(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        """Everything, once there are more than ``most`` documents."""
        if self.held and sum(len(x[0]) for x in self.held) > most:
            row, score, backed = self._added(self.held)
            nulls = [pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(score), pa.array(backed), *nulls], schema=_scored)
            self.held = []


def _score_pairs(heavy: np.ndarray, heavy_n: np.ndarray, heavy_first: np.ndarray, total: int, buckets: int):
    """Sums of log scores by document, and packed (word, document, occurrences) of the pairs that back off."""

    def scored(sums: Sums, first, word, row, n, own) -> tuple[np.ndarray, ...]:
        order, head, size = _counts(mix(first) + word)
        pair_n = np.empty(len(row), np.int64)
        pair_n[order] = np.repeat(np.add.reduceat(n[order], head), size)
        order, head, size = _counts(first)
        first_n = np.empty(len(row), np.int64)
        first_n[order] = np.repeat(np.add.reduceat(n[order], head), size)
        place = np.minimum(np.searchsorted(heavy, first), len(heavy) - 1)
        first_n = np.where(heavy[place] == first, heavy_first[place], first_n)
        seen = pair_n > n
        with np.errstate(divide="ignore"):
            score = n * np.log((pair_n - n) / np.maximum(1, first_n - own))
        sums.add(row[seen], score[seen], np.zeros(int(seen.sum()), np.int64))
        row, word, n = row[~seen], word[~seen], n[~seen]
        place = np.minimum(np.searchsorted(heavy, word), len(heavy) - 1)
        known = heavy[place] == word
        if known.any():
            sums.add(row[known], n[known] * np.log(BACKOFF * heavy_n[place[known]] / total), n[known])
        return row[~known], word[~known], n[~known]

    def asked(held: list) -> Iterator[pa.RecordBatch]:
        row, word, n = (np.concatenate(x) for x in zip(*held))
        bucket = _bucket(word, buckets)
        order = np.lexsort((row, word, bucket))
        row, word, n, bucket = row[order], word[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(row) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(row)).astype(int)):
            yield _block(int(bucket[a]), word[a:b], row[a:b], n[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = [], Sums()
        for columns in _slices(batches, 3, True):
            if len(columns[0]):
                held.append(scored(sums, *columns))
                yield from sums.rows(4 * HELD)
            if sum(len(x[0]) for x in held) >= 2 * HELD:
                yield from asked(held)
                held = []
        yield from sums.rows()
        if held:
            yield from asked(held)

    return run


def _block(bucket: int, word: np.ndarray, row: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Words in ascending order, with the documents that ask for them (COUNT_ROW: a count of the corpus)."""
    heads, sizes = np.unique(word, return_counts=True)
    payload = len(heads).to_bytes(4, "little") + heads.astype("<u8").tobytes() + sizes.astype("<u4").tobytes() + planes(row) + planes(n)
    return pa.RecordBatch.from_pylist([{"bucket": bucket, "payload": payload}], _scored)


def _pack_counts(buckets: int):
    """The corpus's counts by bucket, packed: as many words together as the batches hold, whatever their size."""

    def packed(held: list) -> Iterator[pa.RecordBatch]:
        word, n = (np.concatenate(x) for x in zip(*held))
        bucket = _bucket(word, buckets)
        order = np.lexsort((word, bucket))
        word, n, bucket = word[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(word) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(word)).astype(int)):
            yield _block(int(bucket[a]), word[a:b], np.full(b - a, COUNT_ROW, np.int64), n[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append((batch["word"].to_numpy().view(np.uint64), batch["n"].to_numpy()))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return run


def _score_words(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for word, row, n in _slices(batches, 2, False):
            counts = row == COUNT_ROW
            order = np.argsort(word[counts])
            known, known_n = word[counts][order], n[counts][order]
            word, row, n = word[~counts], row[~counts], n[~counts]
            if len(word):
                share = known_n[np.searchsorted(known, word)] / total
                sums.add(row, n * np.log(BACKOFF * share), n)
                yield from sums.rows(4 * HELD)
        yield from sums.rows()

    return run


@small_batches
def backoff_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_backed_off, log_score (natural, summed) and mean_log_score, one row per input row.

    Words: A-Z lower-cased, split at ASCII white space.  Null and blank texts
    have no words, log_score 0 and a null mean.  Repeated rows are documents of
    their own, so each counts in the other's score.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    counts = docs.select("row", "text").mapInArrow(freed(_word_counts), "word long, n long, last long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("last").alias("last"))
    counts = materialize(counts, "word-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("last"), F.lit(0)).alias("last")).first()
    often = counts.where(F.col("n") * HEAVY >= sums.n).toPandas()  # at most HEAVY words
    # the start mark stands before each text that has words
    heavy = np.append(often["word"].to_numpy(np.int64).view(np.uint64), START)
    heavy_n = np.append(often["n"].to_numpy(np.int64), 0)
    heavy_first = np.append((often["n"] - often["last"]).to_numpy(np.int64), sums.last)
    order = np.argsort(heavy)
    heavy, heavy_n, heavy_first, total = heavy[order], heavy_n[order], heavy_first[order], sums.n
    buckets = partitions(spark)
    pairs = exchange(docs.select("row", "text").mapInArrow(freed(_pairs(heavy, buckets)), "bucket int, payload binary"))
    scored = materialize(pairs.mapInArrow(freed(_score_pairs(heavy, heavy_n, heavy_first, total, buckets)), SCORED), "pair-scores")
    asked = scored.where("bucket IS NOT NULL").select("bucket", "payload")
    tables = counts.mapInArrow(freed(_pack_counts(buckets)), SCORED).select("bucket", "payload")
    backed = exchange(asked.union(tables)).mapInArrow(freed(_score_words(total)), SCORED)
    answers = scored.where("bucket IS NULL").select("row", "score", "backed").union(backed.select("row", "score", "backed"))
    # written here, as what is returned runs with the session's own batches
    summed = materialize(answers.groupBy("row").agg(F.sum("score").alias("score"), F.sum("backed").alias("backed")), "summed")
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return docs.select("row", "doc_id", n_words.alias("n_words")).join(summed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("backed", F.lit(0)).alias("n_backed_off"), F.coalesce("score", F.lit(0.0)).alias("log_score"),
        F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_log_score"),
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Query, str | None]] = {"op10_lm_scores": (op10_lm_scores, None)}
