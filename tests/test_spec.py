import json
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom import spec as S
from clickloom.operators import apply as A
from clickloom.operators import fit
from clickloom.operators import lookups as L
from clickloom.operators import prepare as P

DATASET = S.DatasetSpec(
    labels=(S.DeclaredColumn("y", "int32"), S.DeclaredColumn("z", "int32")),
    features=(S.DeclaredColumn("a", "float32"), S.DeclaredColumn("b", "string")),
)


def test_choose_keeps_order_and_adds_user():
    got = DATASET.choose(["z"], ["b", "a"])
    assert [c.out for c in got.columns()] == ["z", "b", "a", "user_id"]
    assert [c.out for c in DATASET.columns()] == ["y", "z", "a", "b"], "the original is untouched"
    assert [f.name for f in got.to_struct_type()] == ["z", "b", "a", "user_id"]
    assert S.DatasetSpec.from_json(got.to_json()).columns()[0].out == "z"


def test_choose_rejects():
    with pytest.raises(ValueError):
        DATASET.choose(["y", "y"], ["a"])
    with pytest.raises(ValueError):
        DATASET.choose(["y"], ["a", "a"])
    with pytest.raises(KeyError):
        DATASET.choose(["nope"], ["a"])
    with pytest.raises(KeyError):
        DATASET.choose(["y"], ["nope"])


def test_types():
    assert S.type_name("int32") == "Int" and S.const_type([1, 2]) == "IntVec"
    for bad in ("int64", "double", "blob"):
        with pytest.raises(ValueError):
            S.type_name(bad)
    for bad in ([], [1, "a"], {"a": 1}):
        with pytest.raises(ValueError):
            S.const_type(bad)


def test_profile_checks():
    src = S.Source("user_id", 10001, "sex")
    S.ProfileField("u", 0, "Int", src)
    for bad in (
        dict(name="u", default="x", datatype="Int"),
        dict(name="u", default={}, datatype="MapIntFloat32"),
        dict(name="u", default=0, datatype="Int", consts={"A": 1}),
        dict(name="u", default=0, datatype="Int", source=S.Source("planet", 1, "x")),
    ):
        with pytest.raises(ValueError):
            S.ProfileField(**bad)


def test_online_document_versions():
    fields = [
        S.ProfileField("u_gender", 0, "Int", S.Source("user_id", 10001, "sex")),
        S.ProfileField("e_app", "", "String", S.Source("ctx", 0, "e_app")),
        S.ProfileField(
            "u_cnt", {}, "MapIntFloat32", S.Source("user_id", 5, "cnt"),
            expr=lambda: F.lit(1), expr_text="get_map_values(u_cnt, KEYS)", consts={"KEYS": [1, 2]},
        ),
    ]
    one, two = S.online_document(fields, 1), S.online_document(fields, 2)
    assert one["schema"]["u_gender"]["source"] == {"key_type": "user_id", "pid": 10001, "field": "sex"}
    assert two["schema"]["u_gender"]["source"] == {"key_type": "user_id", "field": "10001:sex"}
    assert two["schema"]["e_app"]["source"]["field"] == "e_app"
    assert one["features"][2]["consts"] == {"KEYS": {"value": [1, 2], "type": "IntVec"}}


def test_document_round_trip(spark, tmp_path):
    fields = [
        S.ProfileField("u_gender", 0, "Int", S.Source("user_id", 10001, "sex")),
        S.ProfileField("e_app", "", "String", S.Source("ctx", 0, "e_app")),
        S.ProfileField(
            "u_cnt", {}, "MapIntFloat32", S.Source("user_id", 5, "cnt"),
            expr=lambda: F.lit(1), expr_text="get_map_values(u_cnt, KEYS)", consts={"KEYS": [1, 2]},
        ),
    ]
    for version in (1, 2):
        doc = S.online_document(fields, version)
        path = str(tmp_path / f"doc{version}")
        fit.save_document(spark, path, doc)
        stored = json.loads(spark.read.text(path).first()["value"])
        assert stored == doc
        back = S.fields_from_document(stored, {"u_cnt": lambda: F.lit(1)})
        assert S.online_document(back, version) == doc
        assert back[0].source == S.Source("user_id", 10001, "sex")
    with pytest.raises(KeyError, match="u_cnt"):
        S.fields_from_document(doc)


def test_expand_names():
    got = S.expand_names(["u_{click/comment}_ratio_{3/1}d", "", "# no", "u_view_post_cnt_{14/7}d"])
    assert got == [
        "u_click_ratio_3d", "u_click_ratio_1d", "u_comment_ratio_3d", "u_comment_ratio_1d",
        "u_view_post_cnt_14d", "u_view_post_cnt_7d",
    ]


def test_cast_and_fill(spark):
    df = spark.createDataFrame([("x", None, None, None)], "a string, b string, v array<int>, m map<string,int>")
    out = P.fill_default(
        P.cast_spec(df, {"a": "Int", "b": "String", "v": "Float32Vec", "m": "MapStringFloat32"}),
        {"a": 7, "b": "", "v": [1.0, 2.0], "m": {}},
    )
    assert tuple(out.first()) == (7, "", [1.0, 2.0], None)


def test_same_steps_for_training_and_validation(spark):
    df = spark.createDataFrame([("d1", 1, "5"), ("d1", 2, None)], "dt string, user_id int, age string")
    city = spark.createDataFrame([("d1", 1, "X")], "dt string, user_id int, u_city string")
    out = P.build_training_table(
        df, {"age": "Float32", "u_city": "String"}, {"age": 0.0, "u_city": ""},
        hook=lambda d: d.withColumn("twice", F.col("age") * 2), profile=city,
    )
    assert sorted(tuple(r) for r in out.select("user_id", "age", "u_city", "twice").collect()) == [
        (1, 5.0, "X", 10.0), (2, 0.0, "", 0.0),
    ]


def test_vocabulary_rules(spark):
    data = [("a",)] * 5 + [("b",)] * 5 + [("",)] * 9 + [("c",)]
    df = spark.createDataFrame(data, "c string").withColumn("t", F.col("c"))

    def values(**kw):
        got = fit.fit_vocab(df, [S.CategoryField("c", **kw)])
        return [r["value"] for r in got.orderBy("idx").collect()]

    assert values() == ["a", "b", "c"]
    assert values(min_cnt=2) == ["a", "b"]
    assert values(min_cnt=2, oov_equals_default=False) == ["", "a", "b"]
    tokens = fit.fit_vocab(df, [S.TokensField("t", min_cnt=2)])
    assert [r["value"] for r in tokens.orderBy("idx").collect()] == ["", "a", "b"], "a token default is kept above 1"


def test_vocabulary_numbering_is_that_of_a_window(spark):
    df = spark.range(3000).select(
        F.pmod(F.xxhash64("id"), F.lit(90)).cast("string").alias("a"), F.pmod(F.col("id"), F.lit(7)).cast("string").alias("b")
    )
    fields = [S.CategoryField("a"), S.CategoryField("b")]
    got = fit.fit_vocab(df, fields)
    by_count = Window.partitionBy("feature").orderBy(F.col("count").desc(), "value")
    want = got.drop("idx").withColumn("idx", F.row_number().over(by_count).cast("long"))
    assert got.count() == 97 and got.exceptAll(want).count() == 0


def test_cleanup_before_vocab(spark):
    df = spark.createDataFrame([("a.b.z",), ("z",), ("q.y",)], "c string")
    field = S.CategoryField("c", before_vocab="split_dot_get_last")
    vocab = fit.fit_vocab(df, [field])
    assert {r["value"]: r["idx"] for r in vocab.collect()} == {"z": 1, "y": 2}
    out = A.apply_spec(df, [field], vocab)
    assert sorted(r["c"] for r in out.collect()) == [1, 1, 2]


def test_stats_edge_cases(spark):
    df = spark.createDataFrame([(0.0, 4.0, None)] * 3, "a double, b double, c double")
    got = {r["feature"]: r for r in fit.fit_dense_stats(df, {"a": 0.0, "b": 0.0, "c": 0.0}).collect()}
    assert got["a"]["min"] is None and got["b"]["stddev"] == 0.0 and got["c"]["mean"] is None


def test_apply_spec_errors(spark):
    df = spark.createDataFrame([(1, "a b")], "k int, t string")
    vocab = spark.createDataFrame([("t", "a", 1)], "feature string, value string, idx int")  # no row key: rows are numbered
    assert A.apply_spec(df, [S.TokensField("t", sep=" ", max_len=3)], vocab).first()["t"] == [1, 0, 0]
    with pytest.raises(ValueError, match="no vocabulary"):
        A.apply_spec(df, [S.CategoryField("t")])
    with pytest.raises(ValueError, match="unknown feature kind"):
        A.apply_spec(df, [SimpleNamespace(name="t")])


def test_given_long_vocab_and_weight(spark):
    df = spark.createDataFrame([(1, "v5", "a b c", "0.5 2")], "k int, c string, t string, w string")
    fields = [
        S.CategoryField("c", vocab=tuple(f"v{i}" for i in range(200))),
        S.TokensField("t", vocab=tuple(["b", "a"] + [f"x{i}" for i in range(100)]), max_len=4, weight="w"),
    ]
    r = A.apply_spec(df, fields, keep=["k"], key=["k"]).first()
    assert (r["c"], r["t"], r["w"]) == (6, [2, 1, 0, 0], [0.5, 2.0, 0.0, 0.0])


def test_empty_sequence_lookup(spark):
    df = spark.createDataFrame([(1, [2, 9]), (2, [])], "k int, ids array<int>")
    table = spark.createDataFrame([(2, [1.0]), (9, [3.0])], "idx int, vec array<double>")
    got = {r["k"]: r["v"] for r in L.varlen_embedding_lookup(df, ["k"], "ids", table, "v").collect()}
    assert got[1] == [[1.0], [3.0]] and not got[2]


def test_pretrained_mean_replaces_row_zero(spark):
    stored = spark.createDataFrame([("a", [1.0, 1.0], 0), ("b", [3.0, 5.0], 1)], "word string, vec array<double>, row int")
    vocab = spark.createDataFrame([("b", 1), ("a", 2), ("q", 3)], "value string, idx int")
    got = {r["idx"]: r["vec"] for r in L.pretrained_matrix(vocab, stored).collect()}
    assert got == {0: [2.0, 3.0], 1: [3.0, 5.0], 2: [2.0, 3.0], 3: [2.0, 3.0]}
