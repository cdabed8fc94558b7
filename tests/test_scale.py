"""The skew-safe forms give what the plain forms give, with hot keys present."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom.operators import bands, hotkeys, ranking, trailing
from clickloom.operators import history as H
from clickloom.operators import sampling as S


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    users = [1] * 400 + [rng.randint(2, 30) for _ in range(800)]
    data = [(i, u, rng.randint(0, 200_000), rng.randint(0, 40)) for i, u in enumerate(users)]
    return spark.createDataFrame(data, "id long, u int, sec long, item int").cache()


def brute(events):
    by_user = {}
    for r in sorted(events.collect(), key=lambda r: (r["sec"], r["id"])):
        by_user.setdefault(r["u"], []).append(r)
    return by_user


def test_global_rank_by_group(spark, events):
    got = ranking.global_rank(events, [F.col("sec").desc(), F.col("id").asc()], by=["u"], partitions=7)
    w = Window.partitionBy("u").orderBy(F.col("sec").desc(), F.col("id"))
    want = events.withColumn("rn", F.row_number().over(w).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_global_rank_whole_table(spark, events):
    got = ranking.global_rank(events, [F.col("sec").asc(), F.col("id").asc()], partitions=5)
    ids = [r["id"] for r in got.orderBy("rn").collect()]
    assert ids == [r["id"] for r in events.orderBy("sec", "id").collect()]
    assert got.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()[:] == (1, 1200, 1200)


def test_copies_are_cut_apart(spark):
    """A third of the rows are copies of one row: numbers stay distinct, runs stay even."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("x"))
    got = ranking.global_rank(df, [F.col("x").asc()], partitions=8)
    assert got.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()[:] == (1, 9000, 9000)
    assert got.where("x = -1").agg(F.max("rn")).first()[0] == 3000


def test_hot_keys(events):
    assert [r["u"] for r in hotkeys.hot_keys(events, "u", 100).collect()] == [1]


def test_bursts_are_cut_into_even_slots(spark):
    """2,999 of 3,000 rows within five seconds, then all of them within one: no slot exceeds its rows."""
    for seconds in (5, 1):
        rows = spark.range(3000).select(F.lit(1).alias("u"), "id", F.when(F.col("id") == 0, 0).otherwise(10_000 + F.col("id") % seconds).alias("sec"))
        for order in (["sec", "id"], ["sec"]):
            sizes = hotkeys.add_slots(rows, "u", order, 100).groupBy("_slot").count().collect()
            assert sorted(r["_slot"] for r in sizes) == list(range(30)) and {r["count"] for r in sizes} == {100}


@pytest.mark.parametrize("rows_per_slot", [20, 10**9])
def test_history_with_and_without_slots(events, rows_per_slot):
    got = H.history(events, "u", ["sec", "id"], ["item"], 5, rows_per_slot=rows_per_slot)
    want = {}
    for rows in brute(events).values():
        for n, r in enumerate(rows):
            want[r["id"]] = [x["item"] for x in rows[max(0, n - 5) : n]]
    rows = got.collect()
    assert {r["id"]: r["hist_item"] for r in rows} == want
    assert all(r["seq_length"] == len(r["hist_item"]) for r in rows)


@pytest.mark.parametrize("rows_per_slot", [20, 10**9])
@pytest.mark.parametrize("gap", [1800, 300, 90_000])
def test_sessions_with_and_without_slots(events, rows_per_slot, gap):
    got = H.session_split(
        events, "u", "sec", ["sec", "id"], ["item"], gap, 5, 4, rows_per_slot=rows_per_slot
    )
    want = {}
    for u, rows in brute(events).items():
        sessions = []
        for n, r in enumerate(rows):
            if n == 0 or r["sec"] - rows[n - 1]["sec"] > gap:
                sessions.append([])
            sessions[-1].append(r["item"])
        want[u] = [s[-4:] for s in sessions[-5:]]
    for r in got.collect():
        mine = [r[f"sess_{i}_item"] for i in range(r["sess_length"])]
        assert mine == want.pop(r["u"])
    assert not want


def test_negatives_are_never_positive(spark, events):
    catalog = spark.range(45).select(F.col("id").alias("idx"), (F.col("id") + 100).cast("int").alias("item"))
    positives = events.select("u", F.col("item").cast("long").alias("idx"))
    got = H.negatives(events, "u", positives, catalog, F.xxhash64("id"))
    known = {}
    for r in events.collect():
        known.setdefault(r["u"], set()).add(r["item"])
    rows = got.collect()
    assert len(rows) == 1200
    for r in rows:
        assert r["neg_item"] - 100 not in known[r["u"]]
    everything = spark.range(45).select(F.lit(1).alias("u"), F.col("id").alias("idx"))
    none = H.negatives(events.where("u = 1"), "u", everything, catalog, F.xxhash64("id"))
    assert none.where(F.col("neg_item").isNotNull()).count() == 0


def test_negatives_cyclic_step(spark):
    catalog = spark.range(5).select(F.col("id").alias("idx"), F.col("id").cast("int").alias("item"))
    steps = spark.createDataFrame([(7, i) for i in range(5)], "u int, id long")
    positives = spark.createDataFrame([(7, i) for i in (0, 1, 3, 4)], "u int, idx long")
    got = H.negatives(steps, "u", positives, catalog, F.col("id"))
    assert [r["neg_item"] for r in got.collect()] == [2] * 5


def test_trailing_distinct_against_brute_force(events):
    days = events.withColumn("day", (F.col("sec") / 10_000).cast("int"))
    got = trailing.trailing_distinct(days, ["u"], "item", "day", 3, "n")
    seen = {}
    for r in days.collect():
        seen.setdefault(r["u"], set()).add((r["day"], r["item"]))
    for r in got.collect():
        want = {i for d, i in seen[r["u"]] if r["day"] - 3 <= d <= r["day"] - 1}
        assert r["n"] == len(want)


@pytest.mark.parametrize("slice_seconds", [1, 50_000, 10**9])
def test_trailing_hours_in_slices(events, slice_seconds):
    got = trailing.trailing_hours(events, ["u"], "sec", 12, {"n": F.count(F.lit(1))}, slice_seconds=slice_seconds)
    rows = [(r["u"], r["sec"]) for r in events.collect()]
    want = {(u, s): sum(v == u and s - 43_200 <= t < s for v, t in rows) for u, s in rows}
    found = got.collect()
    assert len(found) == len(want) and {(r["u"], r["sec"]): r["n_12h"] for r in found} == want


def test_exact_quantile(spark):
    values = [float(v) for v in [5, 5, 5, 5, 1, 2, 9, 100, 7, 3, 5]]
    df = spark.createDataFrame([(v, -v) for v in values], "a double, b double")
    import numpy as np

    for q in (0.0, 0.3, 0.95, 1.0):
        got = {r["feature"]: r["quantile"] for r in bands.exact_quantiles(df, ["a", "b"], q, bands=4).collect()}
        assert got["a"] == pytest.approx(np.quantile(values, q)) and got["b"] == pytest.approx(np.quantile([-v for v in values], q))


def test_top_per_group_is_limited_before_the_shuffle(events):
    plan = ranking.top_per_group(events, ["u"], [F.col("sec").desc()], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_split_prefix_small_groups(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 3)], "g string, x int")
    got = {(r["g"], r["x"]): r["side"] for r in S.split_prefix(df, 0.7, [F.col("x").asc()], by=["g"]).collect()}
    assert got == {("a", 1): "right", ("b", 1): "left", ("b", 2): "left", ("b", 3): "right"}
    whole = S.split_prefix(df, 0.5, [F.col("g").asc(), F.col("x").asc()])
    assert sorted(r["x"] for r in whole.where("side = 'left'").collect()) == [1, 1]


@pytest.mark.parametrize("ordered", [True, False])
def test_split_timeline_is_disjoint_and_complete(spark, ordered):
    df = spark.range(3000).select(
        "id", F.concat(F.lit("202401"), F.lpad((F.col("id") % 10 + 1).cast("string"), 2, "0")).alias("dt")
    )
    how = {"order": [F.col("id").asc()]} if ordered else {"key": ["id"]}
    got = S.split_timeline(df, "20240110", 5, **how).cache()
    assert got.count() == got.select("id").distinct().count() == 1800
    days = {(r["split"], r["dt"]) for r in got.select("split", "dt").distinct().collect()}
    assert ("dev", "20240109") in days and ("test", "20240110") in days
    assert {d for s, d in days if s == "dev"} == {"20240109"} and {d for s, d in days if s == "test"} == {"20240110"}
    share = got.where("dt = '20240110' and split = 'train'").count() / 300
    assert share == pytest.approx(0.7, abs=0 if ordered else 0.1)


def test_dates():
    assert S.get_date(-2, "20220103") == "20220101"
    assert S.date_list("20220101", "20220102") == ["20220101"]
    assert S.date_list("20220101", "20220102", True) == ["20220101", "20220102"]
    assert S.date_list("20220105", "20220101", True, step=-2) == ["20220105", "20220103", "20220101"]


def test_shuffle_is_repeatable(spark):
    df = spark.range(500)
    a = [r["id"] for r in S.shuffle_rows(df, ["id"], 1).collect()]
    b = [r["id"] for r in S.shuffle_rows(df.repartition(7), ["id"], 1).collect()]
    assert a == b and a != sorted(a) and sorted(a) == list(range(500))
    assert S.sample_n(df, ["id"], 20, 5).count() == 20


def test_batches(spark):
    got = S.batch_rows(spark.range(10), 4, [F.col("id").asc()])
    assert [r["batch"] for r in got.orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_rows_that_share_a_key_keep_their_own_tokens(spark):
    from clickloom.operators import lookups

    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "c"]), (None, ["z"])], "k int, t array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "value string, idx int")
    out = lookups.index_tokens_by_vocab(rows, ["k"], F.col("t"), vocab, "ids", 3)
    assert sorted(r.ids for r in out.collect()) == [[0, 0, 0], [1, 2, 0], [2, 3, 0]]


def test_steps_without_a_vector_stay_in_place(spark):
    from clickloom.operators import lookups

    rows = spark.createDataFrame([(1, [1, 9, 2]), (1, [2])], "k int, ids array<int>")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "idx int, vec array<double>")
    out = lookups.varlen_embedding_lookup(rows, ["k"], "ids", vectors, "v")
    assert sorted(r.v for r in out.collect()) == [[[1.0, 2.0], [0.0, 0.0], [3.0, 4.0]], [[3.0, 4.0]]]


def test_reports_keep_groups_without_a_name(spark):
    from clickloom.operators import evaluate

    rows = spark.createDataFrame([(s, u, y, p) for s in ("a", None) for u in (1, 2) for y, p in ((1, 0.9), (0, 0.2))], "split string, user int, y int, p double")
    assert {r.split for r in evaluate.ranking_report(rows, "y", "p", "user", ["split"]).collect()} == {"a", None}
    assert evaluate.compare_models(rows, "y", "p", "split", "user").count() == 2


def test_folder_names_are_not_searched(spark, tmp_path):
    from clickloom.sources import tables

    path = str(tmp_path / "mycrc")
    spark.range(4).repartition(2).write.parquet(path)
    assert tables.list_files(spark, path, suffix="*.parquet").count() == 2


def test_padding_does_not_depend_on_the_size_of_the_vocabulary(spark):
    from clickloom.operators.apply import apply_spec
    from clickloom.spec import TokensField

    rows = spark.createDataFrame([(1, "red"), (1, "red blue no")], "k int, t string")
    got = []
    for size in (12, 82):
        words = ["", "red", "blue", *(f"w{i}" for i in range(size - 3))]
        for pad_first in (True, False):
            field = TokensField("t", sep=" ", max_len=3, vocab=words, pad_first=pad_first)
            got.append(sorted(r.t for r in apply_spec(rows, [field]).collect()))
    assert got[0] == got[2] == [[2, 1, 1], [2, 3, 0]]
    assert got[1] == got[3] == [[2, 0, 0], [2, 3, 0]]
