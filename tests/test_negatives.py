import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import history as H


@pytest.mark.parametrize("places", [1, 4, 7, 1 << 15])
def test_negative_histories_select_the_free_places(spark, places):
    rng = random.Random(places)
    n = 40
    known = {u: set(rng.sample(range(n), k)) for u, k in ((1, 0), (2, 1), (3, 20), (4, 39), (5, 40), (6, 33))}
    positives = [(u, i) for u, places_ in known.items() for i in places_] * 2 + [(3, None)]
    rows = [(r % 60, u, [rng.randint(-(10**12), 10**12) for _ in range(rng.randint(0, 5))]) for r, u in enumerate([1, 2, 3, 4, 5, 6, None, 99] * 30)]
    df = spark.createDataFrame([*rows, (500, 3, None)], "k int, u int, picks array<long>")  # keys repeat
    catalog = spark.createDataFrame([(i, f"item{i}") for i in range(n)], "idx long, item string")
    got = H.negative_history(df, ["k"], "u", F.col("picks"), spark.createDataFrame(positives, "u int, idx long"), catalog, "neg", places).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        free = [i for i in range(n) if i not in known.get(r.u, set())]
        assert r.neg == [f"item{free[p % len(free)]}" if free else None for p in r.picks or []]


def test_rows_of_known_blocks_are_bounded(spark):
    events = spark.range(50_000).select(F.lit(7).alias("u"), (F.col("id") % 1000).alias("idx"))
    blocks = H.known_blocks(events, "u", 256).orderBy("block").collect()
    assert [(r.block, len(r.known), r.before) for r in blocks] == [(0, 256, 0), (1, 256, 256), (2, 256, 512), (3, 232, 768)]
