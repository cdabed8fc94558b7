"""Table, text and document sources and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.sampling import get_date, hash_order, split_prefix
from clickloom.storage import shared_dir


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Chosen columns; the selection becomes the scan's read schema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_dates(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """The ``dt`` partitions ``start .. end``; other directories are not listed for reading."""
    return spark.read.option("basePath", path).schema(_with_dt(spark, path)).parquet(path).where(
        F.col("dt").between(start, end)
    )


def _with_dt(spark: SparkSession, path: str) -> T.StructType:
    """File schema with ``dt`` as text (type inference would make it a number)."""
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != "dt"]
    return T.StructType([*fields, T.StructField("dt", T.StringType())])


def write_dates(df: DataFrame, path: str, files_per_day: int | None = None) -> None:
    """Partitioned by ``dt``.

    ``files_per_day`` cuts a day over that many tasks, so that one large day is
    not written by one task.
    """
    if files_per_day:
        own = [c for c in df.columns if c != "dt"]
        # the task number spreads copies of one row as well
        part = F.pmod(F.xxhash64(F.spark_partition_id(), *own), F.lit(files_per_day))
        df = df.repartition(F.col("dt"), part)
    df.write.mode("overwrite").partitionBy("dt").parquet(path)


def write_split(df: DataFrame, path: str, split: str, parts: dict[str, int]) -> None:
    """One directory per split (train, validation), each with its own number of files."""
    for name, n in parts.items():
        df.where(F.col(split) == name).drop(split).repartition(n).write.mode("overwrite").partitionBy("dt").parquet(
            f"{path}/{name}"
        )


def list_files(
    spark: SparkSession,
    path: str,
    skip: Sequence[str] = (),
    sample: int | None = None,
    seed: int = 0,
    suffix: str = "*",
) -> DataFrame:
    """``(path, length)`` of the files below ``path``, bookkeeping files left out.

    Only names are read, never contents.  ``sample`` draws that many files.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", suffix)
        .load(path)
        .select("path", "length")
    )
    # fixed values: name parts of files that are not data
    for token in ["crc", "_SUCCESS", "ipynb", *skip]:
        files = files.where(~F.contains(F.substr("path", F.lit(len(root) + 1)), F.lit(token)))  # names below the root
    return files.orderBy(hash_order(["path"], seed)).limit(sample) if sample else files


WHITESPACE = " \t\r\n\x0b\x0c"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without the white space around them."""
    return spark.read.option("lineSep", "\n").text(path).select(F.btrim("value", F.lit(WHITESPACE)).alias("value"))


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("lineSep", "\n").text(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_vocab_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary lines ``index,value``."""
    return spark.read.schema("idx int, value string").csv(path).select("value", "idx")


def read_vocab_txt(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary lines ``value index`` separated by one space."""
    return spark.read.schema("value string, idx int").option("sep", " ").csv(path)


def content_key(spark: SparkSession, inputs: Sequence[DataFrame | str]) -> str:
    """One short text for the content of tables and of folders of files, whatever the order of rows and files.

    A table counts by its schema, its rows and two sums of their hashes (which
    see nulls and repeated rows); a folder by the paths, lengths and times of
    its files, which are not read.  Either is one aggregation to one row.
    """
    found = []
    for given in inputs:
        if isinstance(given, str):
            reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            rows = reader.load(given).select("path", "length", "modificationTime")
        else:
            rows = given
        # maps have no hash: their entries in order have
        cells = [
            F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
            for f in rows.schema.fields
        ]
        holes = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), holes, *cells).cast("decimal(38,0)"))
        sums = rows.agg(F.count(F.lit(1)), total(1), total(2)).first()
        found.append([rows.schema.json(), *map(str, sums)])
    return hashlib.md5(json.dumps(found).encode()).hexdigest()


def cached_dataset(
    spark: SparkSession,
    task: str,
    batch: int,
    date: str,
    build: Callable[[], DataFrame],
    inputs: Sequence[DataFrame | str] = (),
) -> DataFrame:
    """Prepared dataset, written once under ``task_batch_date`` and then reused.

    With ``inputs`` (tables or folders) the name carries their ``content_key``:
    changed input is built anew, equal input is not.
    """
    key = f"_{content_key(spark, inputs)}" if inputs else ""
    path = f"{shared_dir(spark)}/datasets/{task}_{batch}_{date}{key}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def expired_dates(dates: DataFrame, today: str, keep_days: int) -> DataFrame:
    """Distinct partition dates that are ``keep_days`` or more days old."""
    return dates.select("dt").distinct().where(F.col("dt") <= get_date(-keep_days, today))


def drop_dates(spark: SparkSession, path: str, dates: Sequence[str]) -> list[str]:
    """Delete the given ``dt=`` directories (the only function here that deletes)."""
    gone = []
    for d in dates:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dt={d}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.delete(p, True):
            gone.append(d)
    return gone


def split_files(files: DataFrame, ratio: float) -> DataFrame:
    """Prefix split of a file list in path order."""
    return split_prefix(files, ratio, [F.col("path").asc()])
