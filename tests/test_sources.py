import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.sources import tables, tfrecord
from clickloom.storage import new_path, shared_dir
from clickloom.streaming import features as S


@pytest.fixture(scope="module")
def tf(spark):
    tfrecord.register(spark)
    return spark


def test_crc_known_value():
    masked = int(tfrecord.masked_crcs([b"123456789", b"", b"a" * 70000])[0])
    un = (masked - 0xA282EAD8) & 0xFFFFFFFF
    assert ((un >> 17) | (un << 15)) & 0xFFFFFFFF == 0xE3069283


def test_round_trip(tf, tmp_path):
    data = [(1, -5, 0.5, "é", [1.0, 2.0], ["x", ""]), (2, 7, -1.25, "", [], [])]
    df = tf.createDataFrame(data, "a int, b long, c float, d string, e array<float>, f array<string>")
    path = str(tmp_path / "t")
    df.write.format("tfrecord").mode("overwrite").save(path)
    df.write.format("tfrecord").mode("overwrite").save(path)
    back = tf.read.format("tfrecord").schema(df.schema).load(path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    df.write.format("tfrecord").mode("append").save(path)
    assert tf.read.format("tfrecord").schema(df.schema).load(path).count() == 4


def test_missing_scalar(tf, tmp_path):
    path = str(tmp_path / "t")
    tf.createDataFrame([(1,), (2,)], "a int").write.format("tfrecord").mode("overwrite").save(path)
    wide = tf.read.format("tfrecord").schema("a int, b int")
    with pytest.raises(Exception, match="without a value"):
        wide.load(path).collect()
    assert {r["b"] for r in wide.option("default.b", "9").load(path).collect()} == {9}


def test_damaged_file(tf, tmp_path):
    path = tmp_path / "t"
    tf.createDataFrame([(1,)], "a int").coalesce(1).write.format("tfrecord").mode("overwrite").save(str(path))
    name = next(p for p in path.iterdir() if p.name.endswith(".gz"))
    raw = bytearray(gzip.decompress(name.read_bytes()))
    raw[-5] ^= 0xFF
    name.write_bytes(gzip.compress(bytes(raw)))
    with pytest.raises(Exception, match="checksum"):
        tf.read.format("tfrecord").schema("a int").load(str(path)).collect()


def test_encoding_matches_published_layout():
    # Example { features { feature { key: "a" value { int64_list { value: 1 } } } } }
    import pyarrow as pa
    from pyspark.sql import types as T

    got = tfrecord.encode_batch(
        pa.RecordBatch.from_arrays([pa.array([1])], names=["a"]), T.StructType([T.StructField("a", T.LongType())])
    )[0]
    assert got.hex() == "0a0c" "0a0a" "0a0161" "1205" "1a03" "0a0101"


def test_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.range(100).withColumn("dt", F.concat(F.lit("2024010"), (F.col("id") % 5 + 1).cast("string")))
    tables.write_dates(df, path, files_per_day=2)
    got = tables.read_dates(spark, path, "20240102", "20240103")
    assert got.count() == 40 and got.schema["dt"].dataType.simpleString() == "string"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert tables.drop_dates(spark, path, ["20240101", "20990101"]) == ["20240101"]
    assert not os.path.exists(f"{path}/dt=20240101") and os.path.exists(f"{path}/dt=20240102")
    files = tables.list_files(spark, path, sample=3)
    assert files.count() == 3
    assert tables.split_files(tables.list_files(spark, path), 0.5).where("side = 'left'").count() == tables.list_files(spark, path).count() // 2


def test_lines(spark, tmp_path):
    path = str(tmp_path / "l")
    tables.append_lines(spark.createDataFrame([("  a\t",)], "value string"), path)
    tables.append_lines(spark.createDataFrame([("b",)], "value string"), path)
    assert sorted(r["value"] for r in tables.read_lines(spark, path).collect()) == ["a", "b"]


def test_cached_dataset_is_built_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    name = new_path(spark, "t").rsplit("/", 1)[1]
    for _ in range(2):
        assert tables.cached_dataset(spark, name, 1, "20240101", build).count() == 3
    assert calls == [1]


def test_shared_dir_follows_the_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")


def test_late_rows_are_dropped(spark, tmp_path):
    """Three files, one per trigger: the late row of the last file is ignored."""
    src = tmp_path / "in"
    times = [["2024-01-01 00:10:00", "2024-01-01 20:00:00"], ["2024-01-01 21:00:00"], ["2024-01-01 00:20:00", "2024-01-02 20:00:00"]]
    for i, ts in enumerate(times):
        df = spark.createDataFrame([(t,) for t in ts], "t string").select(F.col("t").cast("timestamp").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(src))
        for f in src.iterdir():
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i)) if f.name.endswith(".parquet") and f.stat().st_mtime > 1_710_000_000 else None
    stream = S.parquet_stream(spark, str(src), "*.parquet", files_per_trigger=1)
    counts = S.stream_counts(stream, "ts", [], {"n": F.count(F.lit(1))}, late="1 hour")
    got = {str(r["start"]): r["n"] for r in S.run_to_table(counts, "late").collect()}
    assert got["2024-01-01 00:00:00"] == 1
    assert got["2024-01-01 10:00:00"] == 2
