"""Packing documents into sequences by best-fit decreasing.

Documents become token ids, cut into full windows and a rest.  Best fit only
depends on how many pieces of each length there are, at most ``CAPACITY``
numbers at any table size, so the fit is planned over lengths: a segment tree
over remaining capacities finds the tightest open windows, and a run of equal
pieces fills a run of equal windows in one step.  Every piece then finds its
place from its number among the pieces of its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import freed, materialize, pieces, prepared, table
from clickloom.llm.tokens import encoder
from clickloom.plans.registry import Query

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 2

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, rank long"
RUNS = "length long, first long, last long, sequence long, each long, offset long"


class TightestOpen:
    """Segment tree over remaining capacities: the smallest one with an open window, at or above a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def at_least(self, length: int) -> int | None:
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over piece counts by length.

    Runs (length, first, last, sequence, each, offset): pieces number first to
    last-1 of that length go, ``each`` to a window, to the windows from
    ``sequence`` on, from ``offset`` on in each.  A length starts at most three
    new runs of equal windows, and a run serves a length once, so the plan is
    bounded by the capacity, whatever the table holds.
    """
    runs, tree, windows = [], TightestOpen(capacity), 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by remaining capacity: (first window, windows)

    def leave(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            free[remaining].append((first, n))
            tree.mark(remaining, True)

    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = tree.at_least(length)
            if room is None:
                room, first = capacity, windows
                have = -(-(n - done) // (capacity // length))
                windows += have
            else:
                first, have = free[room].pop()
                if not free[room]:
                    tree.mark(room, False)
            each = room // length
            take = min(n - done, each * have)
            full, over = divmod(take, each)
            runs.append((length, done, done + take, first, each, capacity - room))
            leave(room - each * length, first, full)
            if over:
                leave(room - over * length, first + full, 1)
            leave(room, first + full + bool(over), have - full - bool(over))
            done += take
    return runs


def _cut(file: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(file), TaskContext.get().partitionId(), defaultdict(int)
        for batch in pieces(batches):
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    out.append((doc_id, start, length, n, ids[4 * start : 4 * (start + length)], part, seen[length]))
                    seen[length] += 1
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
            names = [x.split()[0] for x in PIECES.split(", ")]
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def cut_documents(docs: DataFrame, file: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: full windows and a rest, with their ids (little-endian unsigned 32 bits).

    ``rank`` numbers the pieces of one length in one task (``part``).
    """
    return prepared(docs).mapInArrow(freed(_cut(file, end_id, capacity)), PIECES)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (with length, part and rank; any other columns go along).

    An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    runs = spark.createDataFrame(plan(total, capacity), RUNS)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["length", "part"]).withColumn("number", F.col("base") + F.col("rank"))
    runs = F.broadcast(runs.withColumnRenamed("length", "run_length"))  # bounded by the capacity, see plan()
    placed = numbered.join(runs, (F.col("length") == F.col("run_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
    turn = F.col("number") - F.col("first")
    return placed.withColumns({
        "sequence_id": F.col("sequence") + F.floor(turn / F.col("each")),
        "offset": F.col("offset") + turn % F.col("each") * F.col("length"),
    }).drop("base", "number", "run_length", "first", "last", "sequence", "each", "part", "rank")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_documents(table(spark, sf_dir, "documents"))
    return best_fit(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


QUERIES: dict[str, tuple[Query, str | None]] = {"op1_packing": (op1_packing, None)}
