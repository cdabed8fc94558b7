"""Where intermediate tables live.

Everything that must survive the loss of an executor is a table in the shared
folder named by ``spark.checkpoint.dir``.  A folder of our own is used only
when that setting is empty and Spark runs in one local JVM.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that one job moves where a large table is written in parts: what its shuffles hold on disk is bounded by them.
PART_ROWS = 16_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None
_written: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, list[str]] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="clickloom-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody else uses."""
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; call it when results are stored."""
    return _delete(spark, list(_written))


def _delete(spark: SparkSession, paths: Sequence[str]) -> int:
    gone = 0
    for at in paths:
        _written.remove(at)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Cuts the lineage, fixes the values of partition-dependent columns, and
    gives the optimizer the real size of the table for its join choice.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = [path]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize``, ``in_parts`` or ``whole`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [p for p in _paths.get(t, []) if p in _written])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Of the tables written inside only those put into the list are left at the end.

    Shuffle files go with the write that needed them; they would else stay until
    the driver's JVM next collects its garbage.
    """
    before, kept, was = set(_written), [], spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield kept
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    stay = before.union(*[_paths[t] for t in kept])
    _delete(spark, [p for p in _written if p not in stay])


def part_count(rows: int, most: int | None = None) -> int:
    return max(1, -(-rows // (most or PART_ROWS)))


def in_parts(spark: SparkSession, makes: Sequence[Callable[[], DataFrame]], label: str, **options: str) -> list[DataFrame]:
    """Write one table after the other; what making one wrote and shuffled is gone before the next."""
    out = []
    for make in makes:
        with scratch(spark) as kept:
            out.append(materialize(make(), label, **options))
            kept.append(out[-1])
    return out


def whole(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts written with one schema as one table."""
    if len(parts) == 1:
        return parts[0]
    paths = [p for t in parts for p in _paths[t]]
    out = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths)
    _paths[out] = paths
    return out
