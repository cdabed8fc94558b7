import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clickloom.operators import fit, refit
from clickloom.sources import tables
from clickloom.spec import CategoryField, TokensField
from clickloom.storage import new_path

FIELDS = [CategoryField("c", default="z", min_cnt=3), TokensField("t", sep=" ", max_len=4)]
DENSE = {"x": 0.0, "flat": -1.0}
DAYS = [(datetime.date(2024, 2, 20) + datetime.timedelta(i)).strftime("%Y%m%d") for i in range(20)]


def sample(spark):
    rng = np.random.default_rng(5)
    n = 1500
    day = rng.integers(0, 20, n)
    frame = pd.DataFrame({
        "dt": [DAYS[d] for d in day],
        "c": [None if i % 31 == 0 else f"v{(int(a) + d // 5) % 40}" for i, (a, d) in enumerate(zip(rng.geometric(0.1, n), day))],
        "t": [" ".join(f"w{a}" for a in rng.integers(0, 30, rng.integers(0, 6))) for _ in range(n)],
        "x": np.where(rng.random(n) < 0.1, 0.0, 1e6 + rng.normal(size=n)),
        "flat": 2.0,
    })
    return spark.createDataFrame(frame).where(F.col("dt") != DAYS[9]).cache()  # a day without rows


def same(spark, path, rows, last, n):
    window = rows.where(F.col("dt").between(refit.get_date(1 - n, last), last))
    key = lambda t: sorted(map(tuple, t.collect()))
    assert key(refit.window_vocab(spark, path, FIELDS, last, n)) == key(fit.fit_vocab(window, FIELDS))
    got, want = (
        {r.feature: [r["min"], r["max"], r["mean"], r["stddev"], r["log_mean"], r["log_stddev"]] for r in t.collect()}
        for t in (refit.window_stats(spark, path, last, n), fit.fit_dense_stats(window, DENSE))
    )
    assert got.keys() == want.keys()
    for c in want:
        assert np.allclose(got[c], want[c], rtol=0, atol=2e-6), c


def test_every_window_equals_a_fit_from_scratch(spark):
    rows, path = sample(spark), new_path(spark, "refit")
    refit.add_days(rows, path, FIELDS, DENSE, DAYS[:8])
    for d in DAYS[7:13]:
        refit.add_days(rows, path, FIELDS, DENSE, [d])
        same(spark, path, rows, d, 7)


def test_a_replaced_day_is_counted_again(spark):
    rows, path = sample(spark), new_path(spark, "refit")
    refit.add_days(rows, path, FIELDS, DENSE, DAYS)
    refit.window_counts(spark, path, DAYS[15], 10)
    late = rows.where(F.col("dt") == DAYS[12]).withColumn("c", F.lit("late"))
    refit.add_days(rows.union(late), path, FIELDS, DENSE, [DAYS[12]])
    same(spark, path, rows.union(late), DAYS[15], 10)
    same(spark, path, rows.union(late), DAYS[16], 10)


def test_a_window_that_moves_on_reads_two_days(spark):
    rows, path = sample(spark), new_path(spark, "refit")
    refit.add_days(rows, path, FIELDS, DENSE, DAYS)
    refit.window_counts(spark, path, DAYS[14], 10)
    fs, old = refit._hadoop(spark, f"{path}/counts/dt={DAYS[10]}")
    fs.rename(old, refit._hadoop(spark, f"{path}/hidden")[1])  # a day in the middle is not looked at
    refit.window_counts(spark, path, DAYS[15], 10)
    fs.rename(refit._hadoop(spark, f"{path}/hidden")[1], old)
    same(spark, path, rows, DAYS[15], 10)


def test_a_window_without_rows(spark):
    rows, path = sample(spark), new_path(spark, "refit")
    refit.add_days(rows, path, FIELDS, DENSE, DAYS[:2])
    assert refit.window_counts(spark, path, "20300101", 5).count() == 0
    assert refit.window_stats(spark, path, "20300101", 5).count() == 0


def test_content_key_sees_content_only(spark):
    a = spark.createDataFrame([(1, None, {"x": 1, "y": 2}), (2, "b", None), (2, "b", None)], "i int, s string, m map<string,int>")
    key = lambda *t: tables.content_key(spark, t)
    same_rows = spark.createDataFrame([(2, "b", None), (1, None, {"y": 2, "x": 1}), (2, "b", None)], a.schema)
    assert key(a) == key(same_rows.repartition(5))
    others = [a.where("i = 1"), a.withColumnRenamed("s", "t"), a.withColumn("i", F.col("i") + 1), a.limit(0)]
    assert len({key(t) for t in [a, *others]}) == 5
    two = "a string, b string"
    assert key(spark.createDataFrame([(None, "1")], two)) != key(spark.createDataFrame([("1", None)], two))


def test_changed_input_is_built_anew(spark):
    calls = []
    name = new_path(spark, "t").rsplit("/", 1)[1]
    folder = new_path(spark, "files")
    spark.range(4).write.parquet(folder)

    def build(rows):
        def made():
            calls.append(1)
            return rows
        return made

    for n in (3, 3, 5, 3):
        rows = spark.range(n)
        assert tables.cached_dataset(spark, name, 1, "20240101", build(rows), [rows]).count() == n
    assert len(calls) == 2
    for _ in range(2):
        tables.cached_dataset(spark, name, 2, "20240101", build(spark.range(2)), [folder])
    assert len(calls) == 3
    spark.range(1).write.mode("append").parquet(folder)
    tables.cached_dataset(spark, name, 2, "20240101", build(spark.range(2)), [folder])
    assert len(calls) == 4
