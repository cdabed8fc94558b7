import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import evaluate as E


def pair_auc(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    data = []
    for i in range(900):
        u = 0 if i < 300 else rng.randint(1, 40)
        s = 0.5 if rng.random() < 0.3 else round(rng.random(), rng.choice([1, 6]))
        data.append((u, int(rng.random() < 0.2 + 0.4 * s), s))
    data += [(100, 1, 0.3), (100, 1, 0.4), (101, 0, 0.9)]
    return spark.createDataFrame(data, "u int, y int, s double").cache()


def groups(scored):
    out = {}
    for r in scored.collect():
        out.setdefault(r["u"], []).append((r["y"], r["s"]))
    return out


@pytest.mark.parametrize("bands", [2, 16, 512])
def test_auc_equals_pair_counting(scored, bands):
    rows = [(r["y"], r["s"]) for r in scored.collect()]
    got = E.auc_table(scored, "y", "s", bands=bands).first()
    assert got["auc"] == pytest.approx(pair_auc(rows)) and got["n_rows"] == len(rows)


@pytest.mark.parametrize("bands", [2, 512])
def test_group_auc(scored, bands):
    got = {r["u"]: r["auc"] for r in E.auc_table(scored, "y", "s", ["u"], bands).collect()}
    want = {u: pair_auc(v) for u, v in groups(scored).items()}
    assert got == pytest.approx(want)
    usable = {u: a for u, a in want.items() if a is not None}
    n = {u: len(v) for u, v in groups(scored).items()}
    mean = sum(a * n[u] for u, a in usable.items()) / sum(n[u] for u in usable)
    r = E.gauc(scored, "y", "s", "u", 5).first()
    assert r["gauc"] == round(mean, 5) and r["n_groups"] == len(usable)


def test_single_group_gauc_is_auc(scored):
    one = scored.withColumn("u", F.lit("1"))
    assert E.gauc(one, "y", "s", "u", 6).first()["gauc"] == E.auc_global(one, "y", "s", 6).first()["auc"]


def test_monotone_transform_changes_nothing(scored):
    moved = scored.withColumn("s", F.exp(F.col("s") * 3) - 7)
    assert E.auc_global(moved, "y", "s", 9).first() == E.auc_global(scored, "y", "s", 9).first()


def test_one_class_is_null(scored):
    ones = scored.where("y = 1")
    assert E.auc_global(ones, "y", "s").first()["auc"] is None
    assert E.gauc(ones, "y", "s", "u").first()["gauc"] is None


def test_report_agrees_with_parts(scored):
    two = scored.withColumn("m", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn(
        "s", F.when(F.col("m") == "a", F.col("s")).otherwise(1 - F.col("s"))
    )
    got = {r["m"]: r for r in E.ranking_report(two, "y", "s", "u", ["m"]).collect()}
    assert got["a"]["auc"] == E.auc_global(scored, "y", "s").first()["auc"]
    assert got["a"]["gauc"] == E.gauc(scored, "y", "s", "u").first()["gauc"]
    assert got["a"]["auc"] + got["b"]["auc"] == pytest.approx(1.0, abs=2e-5)


def test_binned_auc(scored):
    rows = [(r["y"], r["s"]) for r in scored.collect()]
    cuts = [-1e-7] + [i / 199 for i in range(1, 199)] + [1 + 1e-7]
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    tp = [sum(1 for y, s in rows if y and s > c) / p for c in cuts]
    fp = [sum(1 for y, s in rows if not y and s > c) / n for c in cuts]
    want = sum((fp[i] - fp[i + 1]) * (tp[i] + tp[i + 1]) / 2 for i in range(len(cuts) - 1))
    assert E.auc_binned(scored, "y", "s").first()["auc"] == pytest.approx(want, abs=1e-6)


def test_losses_clip_and_weight(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (0, 1.0, 0.0)], "y int, p double, w double")
    plain, weighted = E.losses(df, "y", "p").first(), E.losses(df, "y", "p", weight="w").first()
    assert plain["mae"] == 0.5 and weighted["mae"] == 0.0
    assert plain["logloss"] == pytest.approx(8.059048, abs=1e-4) and weighted["label_mean"] == 1.0
