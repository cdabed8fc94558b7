import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import interact as I
from clickloom.operators import train as T

NETS = {
    "linear": dict(use_dnn=False),
    "fm": dict(use_dnn=False, use_fm=True),
    "wide_deep": dict(use_fm=True, tower_units=(5,)),
    "esmm": dict(tasks=("a", "b"), product=True, tower_units=(4, 3)),
    "three_steps": dict(tasks=("a", "b", "c"), product=True, tower_units=(4,)),
    "shared": dict(tasks=("a", "b"), experts=1, expert_units=(6,), tower_units=(3,)),
    "mmoe": dict(tasks=("a", "b"), experts=3, expert_units=(5,), gated=True, tower_units=(3,)),
}


def batch(net, n=12, seed=0):
    rng = np.random.default_rng(seed)
    idx = np.stack([rng.integers(0, v, n) for v in net.vocab_sizes], axis=1)
    return rng.normal(size=(n, net.n_dense)), idx, rng.integers(0, 2, (n, len(net.tasks))).astype(float)


@pytest.mark.parametrize("kind", NETS)
def test_gradient_matches_finite_differences(kind):
    net = T.Network(3, (4, 5), emb_dim=3, **NETS[kind])
    rng = np.random.default_rng(9)
    flat = net.initial(1) + rng.normal(0, 0.1, len(net.initial(1)))
    data = batch(net)
    _, grad = T.loss_and_gradient(net, flat, *data)
    for i in rng.choice(len(flat), min(40, len(flat)), replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        up, _ = T.loss_and_gradient(net, flat + step, *data)
        down, _ = T.loss_and_gradient(net, flat - step, *data)
        assert grad[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)


def test_product_head_is_a_chain():
    p = T.probabilities(T.Network(1, (2,), tasks=("a", "b"), product=True), np.array([[0.0, 1.0]]))
    assert p[0, 1] == pytest.approx(0.5 / (1 + np.exp(-1.0)))


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(2000).select(
        "id", ((F.col("id") * 7919) % 1000 / 500.0 - 1).alias("x"), (F.col("id") % 4).alias("c")
    )
    y = (F.col("x") + F.when(F.col("c") == 2, 1.5).otherwise(-0.5) > 0).cast("int")
    return T.prepare_rows(df.withColumn("y", y), ["x"], ["c"], ["y"], keep=["id"]).cache()


def test_distributed_gradient_equals_local(rows):
    net = T.Network(1, (4,), tasks=("y",), emb_dim=2, tower_units=(3,))
    flat = net.initial(4)
    loss, n, grad = T.gradient_step(rows.repartition(5), net, flat)
    pdf = rows.toPandas()
    want = T.loss_and_gradient(net, flat, np.stack(pdf["dense"]), np.stack(pdf["idx"]), np.stack(pdf["labels"]))
    assert n == 2000 and loss == pytest.approx(want[0]) and np.allclose(grad, want[1])


def test_training_learns_saves_and_reloads(spark, rows, tmp_path):
    net = T.Network(1, (4,), tasks=("y",), emb_dim=2, tower_units=(8,))
    model = T.fit_network(rows, net, valid=rows, epochs=6, steps=3, lr=0.1)
    losses = [h["loss"] for h in model.history]
    assert losses[-1] < losses[0] and model.history[-1]["val_auc"] > 0.9
    path = str(tmp_path / "m")
    T.save_model(spark, model, path)
    again = T.load_model(spark, net, path)
    report = T.verify_saved(rows, ["id"], model, again, "y").first()
    assert report["ok"] and report["n_rows"] == 2000 and report["max_rel_diff"] == 0.0


def test_stop_rule_and_rate():
    rule, w = T.StopRule(2), np.zeros(1)
    assert [rule.update(v, w + v) for v in (0.5, 0.7, 0.6)] == [False, False, False]
    assert rule.update(0.7, w) is True and rule.best == 0.7 and rule.flat[0] == 0.7
    assert [T.learning_rate(1.0, e, 1, 0.5) for e in range(4)] == [1.0, 1.0, 0.5, 0.25]


def test_model_size_is_checked():
    with pytest.raises(ValueError, match="limit"):
        T.Network(1, (100_000_000,)).check_size()


def test_interact_custom_kernel_and_errors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = I.interact(df, ["a", "b"], lambda x, w: x.sum(1) * w["k"], {"k": 2.0}).first()["cross"]
    assert got == [8.0, 12.0]
    holes = spark.createDataFrame([(1, None), (2, [1.0]), (3, None), (4, [5.0])], "k int, a array<double>")
    out = I.interact(holes.coalesce(1), ["a", "a"], lambda x, w: x.sum(1), {})
    assert {r["k"]: r["cross"] for r in out.collect()} == {1: None, 2: [2.0], 3: None, 4: [10.0]}
    with pytest.raises(KeyError):
        I.interact(df, ["a", "b"], "unknown", {})


def test_kernels_against_loops():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 3, 2))
    W = rng.normal(size=(3, 2, 2))
    pairs = [(0, 1), (0, 2), (1, 2)]
    want = np.array([[xi[a] @ (W[p] + W[p].T) @ xi[b] for p, (a, b) in enumerate(pairs)] for xi in x])
    assert np.allclose(I.fefm(x, {"W": W}), want)
    want = np.array([np.concatenate([(xi[a] @ W[p]) * xi[b] for p, (a, b) in enumerate(pairs)]) for xi in x])
    assert np.allclose(I.bilinear(x, {"W": W, "per": "pair"}), want)
    w, b = rng.normal(size=6), rng.normal(size=6)
    x0 = x.reshape(4, 6)
    assert np.allclose(I.cross_net(x, {"kernels": [w], "bias": [b]}), x0 * (x0 @ w)[:, None] + b + x0)


def test_sizes_and_words_beyond_the_given_tables(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from clickloom.plans import q_joins, q_train

    given, sf = "/root/testdata/sf0.001", str(tmp_path)
    for name in os.listdir(given):
        if name != "part.parquet":
            os.symlink(f"{given}/{name}", f"{sf}/{name}")
    part = spark.read.parquet(f"{given}/part.parquet")
    more = part.withColumn("p_brand", F.concat(F.lit("B"), F.col("p_partkey") % 40)).withColumn("p_type", F.concat(F.lit("T"), F.col("p_partkey") % 11))
    more.withColumn("p_name", F.when(F.col("p_partkey") == 1, F.repeat(F.lit("word "), 1500)).otherwise(F.col("p_name"))).write.parquet(f"{sf}/part.parquet")
    ready, sizes = q_train.features(spark, sf)
    assert sizes[1:] == (41, 12)
    assert tuple(ready.agg(*[F.max(c) + 1 for c in q_train.SPARSE]).first()) == sizes
    assert q_train.score_batch(spark, sf).where("pred IS NULL").count() == 0
    assert q_joins.word_rows(spark, sf).where("p_partkey = 1").select(F.size("word_ids")).first()[0] == 1501
