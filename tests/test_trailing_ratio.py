import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import trailing as W


@pytest.mark.parametrize("n", [1, 2, 3, 7, 28])
def test_best_ratio_against_every_day(spark, n):
    """Dense and thin items, days without any row, ratios that come back, nothing to divide by."""
    rng = random.Random(n)
    rows = {}
    for owner in (1, 2, 3):
        for item in range(6):
            for day in rng.sample(range(0, 120), 30 if item % 2 else 4):
                whole = rng.choice([0, 1, 2, 3, 128])
                rows[owner, item, day] = (rng.randint(0, whole) if whole else 0, whole)
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "o int, i int, d int, p long, w long")
    got = {(r.o, r.d): (r.max_ratio, r.avg_ratio) for r in W.trailing_best_ratio(df, "o", "i", "d", "p", "w", n).collect()}
    sums = {}
    for (o, i, d), (p, w) in rows.items():
        for day in range(d + 1, d + n + 1):
            a, b = sums.get((o, day, i), (0, 0))
            sums[o, day, i] = (a + p, b + w)
    want = {}
    for (o, day, _), (p, w) in sums.items():
        want.setdefault((o, day), []).extend([p / w] if w else [])
    assert got.keys() == want.keys()
    for k, ratios in want.items():
        assert got[k][0] == pytest.approx(max(ratios), abs=1e-15) if ratios else got[k] == (None, None)
        assert not ratios or got[k][1] == pytest.approx(sum(ratios) / len(ratios), abs=1e-14)


def test_a_hot_owner_is_not_copied_to_its_days(spark):
    df = spark.range(20_000).select(F.lit(1).alias("o"), (F.col("id") % 1000).alias("i"), (F.col("id") % 200).cast("int").alias("d"), F.lit(1).alias("p"), F.lit(2).alias("w"))
    daily = df.groupBy("o", "i", "d").agg(F.sum("p").alias("p"), F.sum("w").alias("w"))
    intervals = W.ratio_intervals(daily, "o", "i", "d", "p", "w", 28)
    assert intervals.count() <= 2 * daily.count()
    assert W.trailing_best_ratio(daily, "o", "i", "d", "p", "w", 28).agg(F.min("max_ratio"), F.max("avg_ratio")).first()[:] == (0.5, 0.5)
    assert W.trailing_best_ratio(daily.where("d < 0"), "o", "i", "d", "p", "w", 28).count() == 0
