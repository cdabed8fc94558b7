"""Training in runs and parts: the whole job with the same results, and nothing left on disk but what is still read."""

import os
import time
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom import storage
from clickloom.operators import embedding_tables as E
from clickloom.operators import lookups as L
from clickloom.operators import train as T
from clickloom.plans import q_train

LOOKUPS = [E.Lookup("c", "tc"), E.Lookup("e", "te")]


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """The folder of the written tables, empty."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(storage, "_written", [])
    return tmp_path


def names(shared):
    return sorted(x.name.rpartition("-")[0] for x in shared.iterdir())


@pytest.fixture
def rows(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 1000 / 500.0 - 1).alias("x"), (F.col("id") % 5).alias("c"), (F.col("id") * 31 % 40).alias("e"))
    return df.withColumn("y", (F.col("x") + F.when(F.col("c") == 2, 1.5).otherwise(-0.5) > 0).cast("int")).repartition(4)


def trained(spark, rows, valid=None, **options):
    net = T.Network(1, (), ("y",), emb_dim=2, lookups=2, use_fm=True, tower_units=(3,))
    start = E.random_vectors(spark, LOOKUPS, {"tc": 5, "te": 40}, 2, scale=0.1)
    blocks = E.pack(rows, LOOKUPS, ["x"], ["y"], steps=2)
    return E.fit_tables(blocks, net, LOOKUPS, start, valid, epochs=2, lr=0.05, l2={"te": 0.01}, **options)


def test_runs_and_parts_train_the_same_weights(spark, rows, shared, monkeypatch):
    once = trained(spark, rows)
    want = {(r.tab, r.idx): r for r in once.tables.collect()}
    monkeypatch.setattr(E, "BLOCK_ROWS", 100)
    monkeypatch.setattr(E, "RUN_BLOCKS", 2)
    monkeypatch.setattr(E, "RUN_KEYS", 400)
    monkeypatch.setattr(E, "TABLE_ROWS", 20)
    blocks = E.pack(rows, LOOKUPS, ["x"], ["y"])
    runs = E.runs(blocks)
    assert len(runs) > 2 and sorted(r.block for x in runs for r in x.collect()) == sorted(r.block for r in blocks.collect())
    cut = trained(spark, rows)
    got = {(r.tab, r.idx): r for r in cut.tables.collect()}
    assert got.keys() == want.keys() and len(got) == 45 and cut.tables.count() == 45
    assert all(got[k][c] == pytest.approx(r[c], rel=1e-7, abs=1e-9) for k, r in want.items() for c in ("vec", "m", "v"))
    assert np.allclose(cut.flat, once.flat) and [h["loss"] for h in cut.history] == pytest.approx([h["loss"] for h in once.history])


def test_a_fit_leaves_its_last_tables_alone(spark, rows, shared):
    model = trained(spark, rows)
    assert names(shared) == ["blocks", "vectors"] and model.tables.count() == 45


def test_a_fit_with_validation_leaves_its_best_tables_alone(spark, rows, shared):
    held = E.pack(rows.where("id % 3 = 0"), LOOKUPS, ["x"], ["y"])
    model = trained(spark, rows.where("id % 3 > 0"), held)
    assert names(shared).count("vectors") == 1 and "gradients" not in names(shared)
    best = E.score(held, model).select(F.element_at("labels", 1).alias("y"), F.element_at("preds", 1).alias("pred"))
    assert E.auc_table(best, "y", "pred").first()["auc"] == pytest.approx(max(h["val_auc"] for h in model.history))


def test_a_step_leaves_the_tables_it_was_given(spark, rows, shared):
    net = T.Network(1, (), ("y",), emb_dim=2, lookups=2, use_dnn=False)
    model = E.TableModel(net, tuple(LOOKUPS), np.zeros(2), E.with_state(E.random_vectors(spark, LOOKUPS, {"tc": 5, "te": 40}, 2)))
    before = model.tables
    E.train_step(E.pack(rows, LOOKUPS, ["x"], ["y"]), model, 0.1)
    assert names(shared) == ["blocks", "vectors", "vectors"] and before.count() == model.tables.count() == 45


def test_parts_leave_neither_tables_nor_shuffles(spark, shared):
    key = storage._CLEANUP
    spark.conf.set(key, "false")

    def part(c):
        inner = storage.materialize(spark.range(50).withColumn("part", F.lit(c)), "inner")
        return inner.groupBy("part", (F.col("id") % 10).alias("k")).count()

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(blocks.apply(i).getName()) for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_")}

    before, there = storage.materialize(spark.range(3), "before"), shuffled()
    parts = storage.in_parts(spark, [partial(part, c) for c in range(3)], "made")
    assert names(shared) == ["before", "made", "made", "made"] and spark.conf.get(key) == "false"
    spark.conf.unset(key)
    until = time.time() + 20  # they are deleted in the background
    while shuffled() - there and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - there
    every = storage.whole(parts)
    assert every.count() == 30 and every.agg(F.sum("count")).first()[0] == 150 and storage.whole(parts[:1]) is parts[0]
    storage.discard(every)
    storage.discard(parts[0])  # gone already
    assert names(shared) == ["before"] and before.count() == 3


def test_only_large_vocabularies_move_rows_and_none_is_numbered(spark, shared):
    rows = spark.createDataFrame([(1, "a", "u1", ["b", "q"]), (2, None, "u2", []), (2, "zz", None, None), (2, "b", "u2", ["u1", "b"])], "k int, c string, u string, t array<string>")
    vocab = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), *[("u", f"u{i}", i) for i in range(1, 9)], ("u", "u2", 7)], "feature string, value string, idx int")
    inputs = {"c": ("c", F.col("u")), "x": ("u", F.col("u")), "u": ("c", F.col("c")), "w": ("u", F.col("c"))}  # names of columns that others read
    got = L.index_features(rows, [], inputs, vocab, 40)  # 34 bytes of c, 162 of u
    assert got.columns == ["k", "c", "u", "t", "x", "w"] and "numbered" not in names(shared)
    assert sorted((r.k, r.c, r.x, r.u, r.w) for r in got.collect()) == [(1, 0, 1, 1, 0), (2, 0, 0, 0, 0), (2, 0, 7, 0, 0), (2, 0, 7, 2, 0)]
    got = L.index_features(rows, [], {"t": ("c", F.col("t")), "v": ("u", F.col("t")), "i": ("u", F.col("u"))}, vocab.distinct().where("idx < 7"), 40, unique=True)
    assert sorted((r.k, r.t, r.v, r.i) for r in got.collect()) == [(1, [2, 0], [0, 0], 1), (2, [], [], 0), (2, [], [], 2), (2, [0, 2], [1, 0], 2)]


@pytest.mark.parametrize("name", ["train_wide_deep", "train_mmoe"])
def test_query_in_parts_scores_every_row_and_cleans_up(spark, shared, tmp_path_factory, monkeypatch, name):
    sf, given = tmp_path_factory.mktemp("sf"), "/root/testdata/sf0.001"
    for t in os.listdir(given):
        if t != "part.parquet":
            os.symlink(f"{given}/{t}", sf / t)
    part = spark.read.parquet(f"{given}/part.parquet")
    part.union(part.where("p_partkey % 5 = 0")).where("p_partkey % 7 > 0").write.parquet(str(sf / "part.parquet"))  # some twice, some missing
    run = getattr(q_train, name)
    keys = lambda df: sorted(tuple(r) for r in df.select(*q_train.KEYS, "held_out").collect())
    once = run(spark, str(sf))
    want = keys(once)
    assert names(shared) == ["scored"]
    storage.release(spark)
    lines = spark.read.parquet(f"{given}/lineitem.parquet").count()
    monkeypatch.setattr(storage, "PART_ROWS", -(-lines // 2))
    monkeypatch.setattr(E, "TABLE_ROWS", 200)
    monkeypatch.setattr(E, "RUN_KEYS", 1000)
    monkeypatch.setattr(L.index_features, "__defaults__", (1000,))  # ids are joined
    got = run(spark, str(sf))
    assert set(names(shared)) == {"scored"} and len(names(shared)) >= 2
    assert keys(got) == want and len(want) > lines / 2
    preds = [c for c in got.columns if c.startswith("p_")]
    assert got.where(" OR ".join(f"{c} IS NULL OR {c} <= 0 OR {c} >= 1" for c in preds)).isEmpty()
