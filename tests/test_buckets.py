import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.operators import evaluate as E
from clickloom.operators import fit
from clickloom.operators.apply import apply_spec
from clickloom.operators.bands import exact_boundaries
from clickloom.spec import DenseField
from clickloom.storage import new_path


def ranked(values, k):
    s = sorted(values)
    return sorted({s[-(-i * len(s) // k) - 1] for i in range(1, k)})


@pytest.mark.parametrize("bands", [1, 3, 20])
@pytest.mark.parametrize("k", [2, 7, 50])
def test_boundaries_are_the_values_at_exact_ranks(spark, bands, k):
    rng = np.random.default_rng(k)
    a, b = rng.lognormal(size=700).tolist(), rng.integers(0, 5, 700).astype(float).tolist()
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    got = {r.feature: r.bounds for r in exact_boundaries(df, ["a", "b"], k, bands).collect()}
    assert got == {"a": ranked(a, k), "b": ranked(b, k)}


def test_a_hot_value_nulls_nan_and_infinities(spark):
    values = [5.0] * 400 + [float(i) for i in range(100, 300)] + [math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "a double").withColumn("none", F.lit(None).cast("double"))
    got = exact_boundaries(df, ["a", "none"], 4, 5).collect()
    assert [(r.feature, r.bounds) for r in got] == [("a", ranked(values, 4))]
    assert exact_boundaries(df.where("false"), ["a"], 4).count() == 0
    with pytest.raises(ValueError):
        exact_boundaries(df, ["a"], 1)


def test_fitted_bounds_survive_saving_and_reach_the_specification(spark):
    df = spark.range(1, 1001).select("id", F.col("id").cast("double").alias("x"), F.lit(-1.0).alias("y"))
    fields = [DenseField("x", op="bucketize", buckets=4, default=-1.0), DenseField("y", op="bucketize", default=-1.0)]
    path = new_path(spark, "bounds")
    vocab = spark.createDataFrame([("f", "v", 1, 1)], "feature string, value string, count long, idx long")
    fit.save_fitted(path, vocab, vocab, fit.fit_boundaries(df, fields))
    ready = fit.with_boundaries(fields, fit.load_bounds(spark, path))
    assert ready[0].bounds == (250.0, 500.0, 750.0) and ready[1].bounds == ()
    out = apply_spec(df, ready, keep=["id"])
    assert {r.x: r["count"] for r in out.groupBy("x").count().collect()} == {0: 249, 1: 250, 2: 250, 3: 251}
    assert out.where("y <> 0").count() == 0


def loss(y):
    p = sum(y) / len(y) if len(y) else 0
    return -sum(len(y) * q * math.log(q) for q in (p, 1 - p) if q > 0)


def test_cuts_by_label_match_a_greedy_search(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random(900) * 40)
    y = (rng.random(900) < np.where(x < 10, 0.1, np.where(x < 25, 0.7, 0.3))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).withColumn("flat", F.lit(1.0))
    parts, cuts = [(-1.0, 41.0)], []
    candidates = ranked(x.tolist(), 256)
    for _ in range(3):
        best = None
        for lo, hi in parts:
            own = (x >= lo) & (x < hi)
            for c in [c for c in candidates if lo < c < hi and c > x.min()]:
                gain = loss(y[own]) - loss(y[own & (x < c)]) - loss(y[own & (x >= c)])
                if best is None or gain > best[0]:
                    best = (gain, c, lo, hi)
        _, c, lo, hi = best
        parts = [p for p in parts if p != (lo, hi)] + [(lo, c), (c, hi)]
        cuts.append(c)
    got = {r.feature: r.bounds for r in fit.fit_boundaries_by_label(df, ["x", "flat"], "y", 4).collect()}
    assert got == {"x": sorted(cuts), "flat": []}
    assert set(cuts) >= {10.0, 25.0}
    assert fit.fit_boundaries_by_label(df.where("false"), ["x"], "y", 4).count() == 0


def pooled(n, pos):
    """Pooling of adjacent violators."""
    blocks = []
    for a, b in zip(n, pos):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            a2, b2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + c2]
    return [b / a for a, b, c in blocks for _ in range(c)]


@pytest.mark.parametrize("bands", [1, 6])
def test_deciles_and_their_rising_fit(spark, bands):
    rng = np.random.default_rng(bands)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 1200), "s": np.round(rng.random(1200), 2)})
    frame["y"] = (rng.random(1200) < 0.3 + 0.3 * np.sin(9 * frame.s)).astype(int)
    frame.loc[frame.g == 1, "s"] = frame.s.where(frame.s > 0.6, 0.5)  # a frequent score
    got = E.calibration_deciles(spark.createDataFrame(frame), "y", "s", 10, ["g"], bands).toPandas()
    for g, own in frame.groupby("g"):
        cell = ((own.s.rank(method="min") - 1) * 10 // len(own)).astype(int)
        want = own.groupby(cell).agg(n=("y", "size"), pos=("y", "sum"), s=("s", "mean"))
        have = got[got.g == g].sort_values("cell")
        assert have.cell.tolist() == want.index.tolist() and have.n_rows.tolist() == want.n.tolist()
        assert np.allclose(have.mean_pred, want.s, atol=1e-6) and np.allclose(have.mean_label, want.pos / want.n, atol=1e-6)
        assert np.allclose(have.monotone, pooled(want.n, want.pos), atol=1e-6)


def test_deciles_of_nothing_and_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 0.5, 1), (None, None, 1), (1, 0.5, None)], "g int, s double, y int")
    assert [tuple(r) for r in E.calibration_deciles(df, "y", "s", by=["g"]).collect()] == [(None, 0, 1, 0.5, 1.0, 1.0)]
    assert E.calibration_deciles(df.where("false"), "y", "s").count() == 0
