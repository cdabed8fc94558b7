"""Benchmark passages in documents, found although some characters differ.

An item of m characters may differ in k = ``ERRORS`` * m of them.  Cut into
k + 1 pieces, one piece is intact wherever it occurs so, so exact hits of
pieces (one automaton over the pieces of a block of items) are the candidates;
Myers' bit-parallel distance verifies the text around each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import freed, keyed, materialize, table
from clickloom.plans.registry import Query

ERRORS = 0.05
#: Characters of the items that one scan searches for; more items take more scans.
BLOCK_CHARS = 2_000_000

FOUND = "row long, item_id long, start long, end long, distance int"


def plain(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: float = ERRORS) -> list[tuple[int, str]]:
    """(offset, piece) of the item: one more than the edits allowed."""
    n = int(len(item) * errors) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def closest(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of a text that is closest to the item, by Myers' bit vectors."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & every
        right, left = (down | ~(diagonal | up)) & every, up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) & every, (left << 1) & every
        up, down = (left | ~(diagonal | right)) & every, right & diagonal
        best = min(best, (score, j + 1))
    return best


class Searcher:
    """All occurrences of a block of items in a text."""

    def __init__(self, items: list[tuple[int | None, str]], errors: float = ERRORS):
        import ahocorasick

        self.items, self.errors, self.found = items, errors, ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            for offset, piece in pieces(text, errors):
                at[piece].append((i, offset))
        for piece, places in at.items():
            self.found.add_word(piece, (len(piece), places))
        self.found.make_automaton()

    def __call__(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start, end, distance) in the plain text, the closest of each place where hits lie together."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (n, places) in self.found.iter(text):
            for i, offset in places:
                starts[i].add(end + 1 - n - offset)
        out = []
        for i, at in starts.items():
            item_id, item = self.items[i]
            k, m, near = int(len(item) * self.errors), len(item), sorted(at)
            group = [near[0]]
            for s in [*near[1:], None]:
                if s is not None and s - group[-1] <= k:
                    group.append(s)
                    continue
                lo = max(0, group[0] - k)
                window = text[lo : group[-1] + m + k]
                exact = window.find(item)
                distance, end = (0, exact + m) if exact >= 0 else closest(item, window)
                if distance <= k:
                    out.append((item_id, lo + max(0, end - m), lo + end, distance))
                group = [s]
        return sorted(out, key=lambda hit: (hit[0] is not None, hit[0] or 0, hit[1:]))


def _search(items: list[tuple[int | None, str]], errors: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(items, errors)
        for batch in batches:
            out = [(row, *hit) for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()) for hit in search(plain(text))]
            kinds = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["row", "item_id", "start", "end", "distance"])

    return run


def _blocks(benchmark: DataFrame, chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items, some at a time, so that the driver and the tasks hold one bounded block."""
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        text = plain(row.text)
        if text:
            block.append((row.item_id, text))
            n += len(text)
        if n >= chars:
            yield block
            block, n = [], 0
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, item_id, start, end, distance) of every item in every ``keyed`` document, ends in its plain text.

    Null and blank items or documents have no hits; items that repeat are searched once,
    those without an id like all others.
    """
    found = docs.sparkSession.createDataFrame([], FOUND)
    for block in _blocks(benchmark, chars):
        found = found.union(docs.select("row", "text").mapInArrow(freed(_search(block, errors)), FOUND))
    return materialize(found, "passages")


def contamination(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """One row per input row: row, doc_id, n_hits, item_ids (ascending), least_distance (null without a hit), contaminated.

    Items without an id mark a document and count as hits, but have no place in ``item_ids``.
    """
    docs = keyed(docs)
    hits = find_passages(docs, benchmark, errors).groupBy("row").agg(
        F.count("*").alias("n_hits"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("distance").alias("least_distance")
    )
    found = docs.select("row", "doc_id").join(hits, "row", "left")
    return found.select(
        "row", "doc_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        "least_distance", F.col("n_hits").isNotNull().alias("contaminated"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


QUERIES: dict[str, tuple[Query, str | None]] = {"op2_decontamination": (op2_decontamination, None)}
