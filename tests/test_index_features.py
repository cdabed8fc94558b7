"""One pass of vocabulary lookups: the same at every vocabulary size and on both ways."""

import pytest
from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.operators import lookups as L
from clickloom.operators import score as S
from clickloom.operators.apply import apply_spec
from clickloom.spec import CategoryField, TokensField

ROWS = [(1, "red blue no", "b", 3), (1, "red", "b", 3), (None, None, None, None), (2, "", "zz", 7), (2, "blue  blue red red", "a", 3), (3, "no", "", 9)]
SCHEMA = "k int, t string, c string, n int"


def given(size):
    return ["red", "", "blue", *(f"w{i}" for i in range(size - 3))]


@pytest.fixture(params=["tasks", "join"])
def way(request, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(L.index_features, "__defaults__", (-1,))
    return request.param


@pytest.mark.parametrize("pad_first", [True, False])
def test_given_words_of_any_number(spark, way, pad_first):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = []
    for size in (12, 64, 65, 82, 700):
        field = TokensField("t", sep=" ", max_len=3, vocab=given(size), pad_first=pad_first)
        got.append(sorted((str(r.k), r.c, r.t) for r in apply_spec(rows, [field], keep=["k", "c"], key=["k"]).collect()))
        make = C.split_index_v2 if pad_first else C.split_pad_index
        got.append(sorted((str(r.k), r.c, r.t) for r in rows.select("k", "c", make("t", given(size), 3, " ").alias("t")).collect()))
    pad = 2 if pad_first else 0
    assert all(g == got[0] for g in got)
    assert [t for *_, t in got[0]] == [[1, pad, pad], [1, 3, 0], [3, 2, 3], [2, pad, pad], [0, pad, pad], [2, pad, pad]]


def test_many_features_of_shared_and_own_vocabularies(spark, way):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumns({f"c{i}": F.concat("c", F.lit(str(i % 3))) for i in range(20)})
    vocab = [("t", "red", 1), ("t", "blue", 2), ("n", "3", 1), ("n", "9", 2)] + [(f"c{i}", f"{v}{i % 3}", j) for i in range(20) for j, v in enumerate("ab", 1)]
    vocab = spark.createDataFrame(vocab, "feature string, value string, idx int")
    fields = [TokensField("t", sep=" ", max_len=2), CategoryField("n"), *[CategoryField(f"c{i}") for i in range(20)], CategoryField("c", vocab=[f"x{i}" for i in range(99)] + ["b"])]
    got = apply_spec(rows, fields, vocab, keep=["k"], key=["k"])
    assert got.columns == ["k", "t", "n", *[f"c{i}" for i in range(20)], "c"]
    want = [(1, [1, 2], 1, 2, 2, 100), (1, [1, 0], 1, 2, 2, 100), (None, [0, 0], 0, 0, 0, 0), (2, [0, 0], 0, 0, 0, 0), (2, [2, 0], 1, 1, 1, 0), (3, [0, 0], 2, 0, 0, 0)]
    assert sorted(((r.k, r.t, r.n, r.c0, r.c19, r.c) for r in got.collect()), key=str) == sorted(want, key=str)
    assert apply_spec(rows.where("k > 9"), fields, vocab).count() == 0


def test_arrays_keep_every_element(spark, way):
    rows = spark.createDataFrame([(1, ["a", None, "b", "q"]), (1, []), (2, None)], "k int, t array<string>")
    vocab = spark.createDataFrame([("f", "a", 5), ("f", "b", 7), ("g", "q", 9)], "feature string, value string, idx int")
    got = L.index_features(rows, ["k"], {"x": ("f", F.col("t")), "y": ("g", F.get("t", F.lit(3)))}, vocab)
    assert sorted((r.k, r.x, r.y) for r in got.collect()) == [(1, [], 0), (1, [5, 0, 7, 0], 9), (2, [], 0)]


def test_rows_that_share_a_key_have_their_own_sums(spark):
    rows = spark.createDataFrame([(1, [1]), (1, [2]), (None, [2, 2, 0]), (3, [])], "k int, t array<int>")
    weights = spark.createDataFrame([("t", 1, 1.0), ("t", 2, 10.0)], "feature string, idx int, weight double")
    got = S.score_linear(rows, weights, tokens=["t"], key=["k"])
    assert got.columns == ["k", "t", "logit", "pred"]
    assert sorted((r.t, r.logit) for r in got.collect()) == [([], 0.0), ([1], 1.0), ([2], 10.0), ([2, 2, 0], 20.0)]
