import numpy as np
import pytest

from clickloom.llm import whitening
from clickloom.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, n int, component string, whitened array<int>"


def brute(vectors, components=32):
    """Component values by a full decomposition, deviations by Python numbers."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    moved = x * len(x) - x.sum(axis=0)
    c = (moved / len(x)).astype(float)
    e, q = np.linalg.eigh(c.T @ c / len(x))
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-10 * e[0]).sum()))
    return (moved**2).sum(axis=1).tolist(), e[:k], c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return out


def test_whitening_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    deviation, e, whitened, explained = brute([r.embedding for r in rows])
    got = found(whitening.op11_embedding_whitening(spark, sf))
    assert len(got) == len(rows) and all(len(g) == 32 for g in got.values())
    mine = np.array([[got[r.vec_id][j + 1][0].whitened for j in range(32)] for r in rows])
    sign = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine * sign - whitened).max() < 1e-9
    assert [got[r.vec_id][1][0].deviation for r in rows] == deviation
    first = got[rows[0].vec_id]
    assert np.allclose([first[j + 1][0].explained for j in range(32)], explained, rtol=1e-9)
    assert first[1][0].n == len(rows) and first[1][0].identity_error < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=5).astype(np.float32)], 7, "clash", [1]) for i in range(40)]
    good += [(3, good[3][1], 7, "again", None), (None, good[4][1], 7, None, None), (None, good[4][1], None, None, None)]
    odd = [(90, None), (91, []), (92, [1.0] * 4), (93, [1.0, None, 1.0, 1.0, 1.0]), (94, [1.0, float("nan"), 1.0, 1.0, 1.0]),
           (95, [float("inf")] + [1.0] * 4), (96, [3e38] * 5), (97, [1.0] * 6)]
    df = spark.createDataFrame(good + [(i, v, 0, "x", None) for i, v in odd], SCHEMA)
    deviation, e, whitened, explained = brute([g[1] for g in good])
    got = found(whitening.whiten(df))
    assert set(got) == {g[0] for g in good}
    assert len(got[None][1]) == 2 and len(got[3][5]) == 2 and max(got[0]) == 5
    assert got[0][1][0].n == len(good) and got[0][1][0].identity_error < 1e-9
    assert [got[i][1][0].deviation for i in range(40)] == deviation[:40]
    mine = np.array([[got[i][j + 1][0].whitened for j in range(5)] for i in range(40)])
    assert np.abs(np.abs(mine) - np.abs(whitened[:40])).max() < 1e-9


def test_vectors_of_lower_rank_and_none(spark):
    flat = [(i, [float(i % 7), float(2 * (i % 7)), float(i % 3), 4.0], 0, "", None) for i in range(50)]
    got = found(whitening.whiten(spark.createDataFrame(flat, SCHEMA)))
    assert max(got[0]) == 2 and got[0][1][0].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, "", None) for i in range(3)], SCHEMA)).count() == 0


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2.0**40 * (i % 5)), float(i)], 0, "", None) for i in range(20)]
    deviation, *_ = brute([r[1] for r in rows])
    got = found(whitening.whiten(spark.createDataFrame(rows, SCHEMA)))
    assert [got[i][1][0].deviation for i in range(20)] == [d if d < 1 << 63 else None for d in deviation]


@pytest.mark.parametrize("spectrum", ["flat", "steep", "equal", "zero", "spike"])
def test_leading_pairs(spectrum):
    d, rng = 200, np.random.default_rng(1)
    e = {"flat": np.linspace(1, 0.9, d), "steep": 0.5 ** np.arange(d), "equal": np.repeat([3.0, 1.0], d // 2),
         "zero": np.r_[np.linspace(2, 1, 20), np.zeros(d - 20)], "spike": np.r_[1e6, 4e3, np.linspace(1, 0.7, d - 2)]}[spectrum]
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = (basis * e) @ basis.T
    passes = []
    values, q = whitening.leading_pairs(lambda m: passes.append(1) or v @ m, d, 32)
    assert np.allclose(values, e[:32], rtol=1e-10, atol=1e-11 * e[0])
    assert np.abs(v @ q - q * values).max() <= 1e-11 * e[0] and np.abs(q.T @ q - np.eye(32)).max() < 1e-11
    assert len(passes) < 400
