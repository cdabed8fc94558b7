import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.functions import crosses as X
from clickloom.functions import dense as D
from clickloom.functions import expressions as E
from clickloom.functions import pooling as P
from clickloom.functions import vectors as V


def one(spark, column, schema="a int", data=((1,),)):
    return spark.createDataFrame(list(data), schema).select(column.alias("r")).first()["r"]


def many(spark, column, schema, data):
    return [r["r"] for r in spark.createDataFrame(data, schema).select(column.alias("r")).collect()]


def test_index_literal_unknown_is_zero(spark):
    got = many(spark, C.index_literal("c", ["a", "b"]), "c string", [("a",), ("b",), ("zzz",), (None,)])
    assert got == [1, 2, 0, 0]


def test_dense_normal(spark):
    assert many(spark, D.normal("x", 0, 100), "x int", [(10,), (50,), (100,)]) == [0.1, 0.5, 1.0]


def test_split_pad_index(spark):
    got = many(spark, C.split_pad_index("c", ["a", "b", "x"], 5), "c string", [("a,b,x",), ("zz",), ("",), ("a,a,b,b,x,x",)])
    assert got == [[1, 2, 3, 0, 0], [0] * 5, [0] * 5, [1, 1, 2, 2, 3]]


def test_split_pad_number(spark):
    got = many(spark, C.split_pad_number("c", 5), "c string", [("0,4,1",), ("",)])
    assert got == [[0, 4, 1, 0, 0], [0] * 5]


def test_str_to_vec(spark):
    assert one(spark, V.str_to_vec("c", 3), "c string", [("0.5,-0.25,0.125",)]) == [0.5, -0.25, 0.125]
    assert one(spark, V.str_to_vec("c", 3), "c string", [(None,)]) is None
    with pytest.raises(Exception, match="vector length"):
        one(spark, V.str_to_vec("c", 3), "c string", [("1,2",)])


def test_cosine_halves(spark):
    data = [([1.0, 2.0, 3.0, 4.0, -1.0, -2.0, -3.0, -4.0],), ([1.0, 2.0, 3.0, 4.0] * 2,), ([0.0] * 4 + [1.0] * 4,)]
    got = many(spark, V.cosine_halves("v", 4), "v array<double>", data)
    assert got[:2] == pytest.approx([-1.0, 1.0]) and got[2] == 0.0


def test_two_generations_differ(spark):
    x = -2.0
    assert one(spark, D.log(F.lit(x))) == pytest.approx(math.log(3))
    assert one(spark, D.log_v2(F.lit(3.0), 2)) == pytest.approx(2.0)
    assert one(spark, D.log_normal(F.lit(x), 5, 3)) == pytest.approx((math.log(3) - math.log(5)) / math.log(3))
    assert one(spark, D.log_normal_v2(F.lit(2.0), 5, 3)) == pytest.approx((math.log(3) - 5) / 3)


@pytest.mark.parametrize(
    "call",
    [
        lambda: D.normal("a", 0, 0),
        lambda: D.min_max("a", 0, 0),
        lambda: D.min_max_v2("a", 3, 3),
        lambda: D.log_normal("a", 1, 1),
        lambda: D.log_normal("a", -1, 2),
        lambda: D.log_normal("a", 1, -2),
        lambda: D.log_normal_v2("a", 1, 0),
        lambda: D.divide("a", 0),
        lambda: D.by_name("cube", "a"),
        lambda: D.by_name("normal", "a", None, None),
        lambda: C.vocab_map(range(1000)),
        lambda: C.cleanup("nothing", "a"),
        lambda: P.pool("odd", F.col("a"), F.col("a"), 2),
    ],
)
def test_bad_parameters(spark, call):
    with pytest.raises(ValueError):
        call()


def test_clip_and_null(spark):
    got = many(spark, D.clip("x", 0, 5), "x double", [(-1.0,), (7.0,), (None,)])
    assert got == [0.0, 5.0, None]


def test_hash_bucket_range_and_mask(spark):
    df = spark.range(5000).withColumn("b", C.hash_bucket("id", 50, mask_zero=True)).withColumn("p", C.hash_bucket("id", 50))
    b = {r["id"]: r["b"] for r in df.collect()}
    assert b[0] == 0 and all(1 <= v < 50 for k, v in b.items() if k)
    assert len(set(b.values())) == 50
    assert df.where((F.col("p") < 0) | (F.col("p") >= 50)).count() == 0


def test_expressions(spark):
    m = F.create_map(F.lit("a"), F.lit(2.0))
    assert one(spark, E.get_map_values(m, ["b", "a"])) == [0.0, 2.0]
    assert one(spark, E.last_segment(F.lit("a.b.c"))) == "c"
    assert one(spark, E.last_segment(F.lit("abc"))) == "abc"
    assert one(spark, E.if_equal(F.lit(3), 3, "y", "n")) == "y"
    day = F.lit("2024-03-01 05:00:00").cast("timestamp_ntz")
    before = F.lit("2024-02-28 23:00:00").cast("timestamp_ntz")
    assert one(spark, E.time_count(day, before)) == 2
    assert one(spark, E.time_count(day, before, "h")) == 30
    assert one(spark, E.time_count(day, F.lit(None).cast("timestamp_ntz"))) == 0
    assert one(spark, E.weekday(F.lit("2024-01-01").cast("timestamp_ntz"))) == 0
    assert one(spark, E.same(F.lit(None).cast("int"), F.lit(1))) == 0


def test_pooling_properties(spark):
    rng = np.random.default_rng(1)
    seq = rng.normal(size=(3, 4, 2))
    mask = [[1, 1, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1]]
    data = [(s.tolist(), m) for s, m in zip(seq, mask)]
    schema = "s array<array<double>>, m array<int>"
    total = np.array(many(spark, P.pool_sum("s", "m", 2), schema, data))
    mean = np.array(many(spark, P.pool_mean("s", "m", 2), schema, data))
    top = np.array(many(spark, P.pool_max("s", "m", 2), schema, data))
    n = np.array(mask).sum(1)
    assert np.allclose(mean * (n[:, None] + 1e-6), total)
    assert np.allclose(total[1], 0) and np.all(top[1] < -9e8)
    assert np.allclose(top[0], seq[0][:2].max(0))
    att = np.array(many(spark, P.pool_attention_dot("s", F.array(F.lit(1.0), F.lit(-1.0)), "m", 2), schema, data))
    score = np.where(np.array(mask) == 1, (seq @ np.array([1.0, -1.0])) / np.sqrt(2), 1e-12)
    w = np.exp(score) / np.exp(score).sum(1, keepdims=True)
    assert np.allclose(att, (w[:, :, None] * seq).sum(1))


def test_fm_is_sum_of_inner_products(spark):
    rng = np.random.default_rng(2)
    data = [tuple(v.tolist() for v in rng.normal(size=(3, 4))) for _ in range(5)]
    df = spark.createDataFrame(data, "a array<double>, b array<double>, c array<double>")
    for r in df.select(X.fm_second_order(["a", "b", "c"]).alias("fm"), X.inner_product(["a", "b", "c"]).alias("ip")).collect():
        assert r["fm"] == pytest.approx(sum(r["ip"]))


def test_position_encoding_and_layer_norm(spark):
    got = np.array(one(spark, V.position_encoding(F.col("s"), 4, zero_pad=False), "s array<array<double>>", [([[0.0] * 4] * 3,)]))
    pos = np.arange(3)[:, None] / np.power(10000, 2 * (np.arange(4) // 2) / 4)
    want = np.where(np.arange(4) % 2 == 0, np.sin(pos), np.cos(pos)) * 2.0
    assert np.allclose(got, want)
    flat = one(spark, V.layer_norm(F.array(F.lit(3.0), F.lit(3.0))))
    assert flat == [0.0, 0.0]


def test_k_max(spark):
    assert one(spark, C.k_max("v", 2), "v array<int>", [([3, 9, 5],)]) == [9, 5]
