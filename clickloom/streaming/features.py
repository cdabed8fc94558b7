"""The same feature Columns on a stream, and sliding counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.apply import apply_spec
from clickloom.operators.prepare import cast_spec, fill_default
from clickloom.spec import Field
from clickloom.storage import new_path


def parquet_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream; the schema is read from the files there now."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_features(
    stream: DataFrame,
    types: Mapping[str, str],
    defaults: Mapping,
    fields: Sequence[Field],
    vocab: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Cast, fill, index and normalize arriving rows (static vocabulary joins)."""
    return apply_spec(fill_default(cast_spec(stream, types), defaults), fields, vocab, keep)


def stream_counts(
    stream: DataFrame,
    time: str,
    keys: Sequence[str],
    measures: Mapping,
    window: str = "12 hours",
    slide: str = "1 hour",
    late: str = "30 minutes",
) -> DataFrame:
    """Sliding behaviour counts; rows later than ``late`` are dropped by the watermark."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window, slide), *keys)
        .agg(*[c.alias(n) for n, c in measures.items()])
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *measures)
    )


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available now, exactly once, into a parquet table."""
    spark = stream.sparkSession
    path, state = new_path(spark, label), new_path(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
