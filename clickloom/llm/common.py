"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import ship_package
from clickloom.storage import materialize

__all__ = ["binary", "exchange", "components", "freed", "keyed", "materialize", "partitions", "pieces", "planes", "prepared", "ship_package", "small_batches", "table", "uint64", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def prepared(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null: empty) and ``keep``; other columns of the input never meet ours."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(), *keep)


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them set for the size of its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exchange(blocks: DataFrame, key: str = "bucket") -> DataFrame:
    """Deal packed blocks out by bucket, as many partitions as the session shuffles into."""
    return blocks.repartition(partitions(blocks.sparkSession), key)


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Strings of a column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows: texts leave Arrow's memory a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker, which stays for later tasks, hands memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what lies below the last block in use
            trim(0)

    return whole


#: Rows of an Arrow batch of whole texts, and bytes from which a batch of texts or packed blocks is closed.
TEXT_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """What ``plan(docs, ...)`` writes goes to Python in batches of ``TEXT_ROWS`` rows or about ``BATCH_BYTES``: an executor holds a batch twice beside its heap."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": TEXT_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}

    @wraps(plan)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        conf, number = docs.sparkSession.conf, docs.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        before = {key: conf.get(key) for key in limits}
        for key, most in limits.items():
            if before[key].startswith("-") or not 0 < number(before[key]) <= most:
                conf.set(key, str(most))
        try:
            return plan(docs, *args, **kwargs)
        finally:
            for key, value in before.items():
                conf.set(key, value)

    return run


def uint64(raw: Iterator[bytes] | list[bytes], dtype: str = "<u8") -> np.ndarray:
    """Packed numbers of many blocks as one array."""
    return np.frombuffer(b"".join(raw), dtype)


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """``prepared`` with ``row``, a key of the rows: doc_id where that is one, else a written number in its order."""
    base = prepared(docs, *keep)
    twice = base.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if twice.isEmpty():
        return base.withColumn("row", F.col("doc_id"))
    return materialize(base.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("row", F.monotonically_increasing_id()), "numbered")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), for every node that has one.

    Each round hooks every component to its least neighbour and shortens the
    paths, so the rounds grow with the logarithm of the longest chain; labels
    are written once a round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    links = materialize(both, "links")
    labels = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        name = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        lower = links.join(name, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("lower"))
        step = labels.join(lower, "node").select("node", "component", F.least("component", "lower").alias("hooked"))
        # the component a node is hooked to may itself have moved: the lowest label any of its nodes has seen
        best = step.groupBy("component").agg(F.min("hooked").alias("best"))
        moved = step.join(best, "component").select("node", F.col("component").alias("before"), F.least("hooked", "best").alias("component"))
        moved = materialize(moved, "labels")
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("next")).distinct()
        labels = materialize(moved.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
        if moved.where("component <> before").isEmpty():
            return labels


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all lowest bytes first: sorted or small numbers then compress well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: np.ndarray) -> np.ndarray:
    """The numbers behind ``planes``."""
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


#: Bytes of a table that is sent to every executor, at most; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def checked_broadcast(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows as they lie in memory are small."""
    width = 16 * len(rows.columns)
    sizes = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in rows.schema.fields if f.dataType.typeName() in ("binary", "string")]
    found = rows.agg(F.count("*").alias("n"), sum(sizes, F.lit(0)).alias("bytes")).first()
    return F.broadcast(rows) if found.n * (width + 32) + found.bytes <= BROADCAST_BYTES else rows
