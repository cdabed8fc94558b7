import hashlib

import pytest
from pyspark.sql import functions as F

from clickloom.operators import sampling as S


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("n", [0, 1, 7, 2500, 4999, 5000, 9000])
def test_exactly_n_of_the_smallest_numbers(spark, n):
    got = [r.id for r in S.sample_n(spark.range(5000), ["id"], n, seed=3).collect()]
    assert sorted(got) == sorted(sorted(range(5000), key=lambda i: number(3, i))[:n])


def test_copies_of_a_key_are_cut_to_n(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    for n in (10, 500, 1500, 2999):
        rows = S.sample_n(df, ["k"], n, seed=1).collect()
        assert len(rows) == n == len({r.id for r in rows})
    assert S.sample_n(df.where("id < 0"), ["k"], 5).count() == 0


def test_a_large_sample_stays_in_many_tasks(spark):
    sizes = S.sample_n(spark.range(0, 40_000, 1, 8), ["id"], 30_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 8_000
