"""Feature crosses over 8 field vectors of 8 numbers."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from clickloom.functions import crosses as X
from clickloom.operators.interact import interact
from clickloom.operators import score as S
from clickloom.plans.registry import query
from clickloom.plans.views import field_vectors, field_vectors_sql, fixed

K = D = 8
FIELDS = [f"f{i}" for i in range(K)]
PAIRS = list(combinations(range(K), 2))
CELLS = f"""{field_vectors_sql()},
  long AS (SELECT vec_id, label, unnest([{', '.join(FIELDS)}]) AS v, unnest([0,1,2,3,4,5,6,7]) AS f FROM fields),
  cells AS (SELECT vec_id, label, f, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM long),
  pairs AS (SELECT a.vec_id, a.f AS a, b.f AS b, a.v AS va, b.v AS vb, a.f * (15 - a.f) // 2 + b.f - a.f - 1 AS p
    FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.f < b.f),
  prods AS (SELECT vec_id, p, unnest(va) AS xa, unnest(vb) AS xb, generate_subscripts(va, 1) - 1 AS i FROM pairs)"""
FX = "CAST(round({} * 1e6) AS BIGINT)"


def formula(*shape):
    """Fixed test weights: a formula of the indices that SQL can repeat."""
    n = np.ones(shape)
    for axis, (size, shift) in enumerate(zip(shape, (1, 3, 5))):
        n = n * (np.arange(size) + shift).reshape([-1 if a == axis else 1 for a in range(len(shape))])
    return (n % 7 - 3) / 10.0


def weight_sql(*idx) -> str:
    product = " * ".join(f"({i} + {shift})" for i, shift in zip(idx, (1, 3, 5)))
    return f"(({product}) % 7 - 3) / 10.0::DOUBLE"


def joined(source: str, order: str, value: str = "z") -> str:
    return f"array_to_string(list({FX.format(value)} ORDER BY {order}), ',') FROM {source} GROUP BY vec_id"


SQUARES = "SELECT vec_id, i, (sum(x) * sum(x) - sum(x * x)) / 2 AS z FROM cells GROUP BY vec_id, i"


@query("fm_second_order", f"WITH {CELLS} SELECT vec_id, round(sum(z), 6) AS fm FROM ({SQUARES}) GROUP BY vec_id")
def fm_second_order(spark, sf):
    return field_vectors(spark, sf).select("vec_id", F.round(X.fm_second_order(FIELDS), 6).alias("fm"))


@query(
    "fm_grouped",
    f"""WITH {CELLS} SELECT vec_id, round(sum(z), 6) AS fm FROM (SELECT vec_id, i, f >= 3 AS g,
    (sum(x) * sum(x) - sum(x * x)) / 2 AS z FROM cells GROUP BY ALL) GROUP BY vec_id""",
)
def fm_grouped(spark, sf):
    groups = {"user": FIELDS[:3], "item": FIELDS[3:]}
    return field_vectors(spark, sf).select("vec_id", F.round(X.fm_grouped(groups), 6).alias("fm"))


@query("bi_interaction", f"WITH {CELLS} SELECT vec_id, {joined(f'({SQUARES})', 'i').replace(' FROM', ' AS v FROM', 1)}")
def bi_interaction(spark, sf):
    return field_vectors(spark, sf).select("vec_id", fixed(X.bi_interaction(FIELDS)).alias("v"))


@query(
    "inner_product",
    f"""WITH {CELLS}, d AS (SELECT vec_id, p, sum(xa * xb) AS z FROM prods GROUP BY 1, 2)
    SELECT vec_id, dots, prod FROM (SELECT vec_id, {joined('d', 'p').replace(' FROM', ' AS dots FROM', 1)})
    JOIN (SELECT vec_id, {joined('prods', 'p, i', 'xa * xb').replace(' FROM', ' AS prod FROM', 1)}) USING (vec_id)""",
)
def inner_product(spark, sf):
    rows = field_vectors(spark, sf)
    return rows.select(
        "vec_id",
        fixed(X.inner_product(FIELDS)).alias("dots"),
        fixed(F.flatten(X.inner_product(FIELDS, reduce=False))).alias("prod"),
    )


@query(
    "fwfm",
    f"""WITH {CELLS} SELECT vec_id, round(sum({weight_sql('a', 'b')} * list_dot_product(va, vb)), 6) AS z FROM pairs GROUP BY vec_id""",
)
def fwfm(spark, sf):
    return field_vectors(spark, sf).select("vec_id", F.round(X.fwfm(FIELDS, formula(K, K).tolist()), 6).alias("z"))


SQUARE = """sq AS (SELECT vec_id, p, ia.i AS i, ib.i AS j, va[ia.i + 1] AS xa, vb[ib.i + 1] AS xb
  FROM pairs, range(8) ia(i), range(8) ib(i))"""


@query(
    "fefm",
    f"""WITH {CELLS}, {SQUARE}, z AS (SELECT vec_id, p, sum(xa * ({weight_sql('p', 'i', 'j')} + {weight_sql('p', 'j', 'i')}) * xb) AS z FROM sq GROUP BY 1, 2)
    SELECT vec_id, {joined('z', 'p').replace(' FROM', ' AS v FROM', 1)}""",
)
def fefm(spark, sf):
    out = interact(field_vectors(spark, sf), FIELDS, "fefm", {"W": formula(len(PAIRS), D, D)}, "v")
    return out.select("vec_id", fixed("v").alias("v"))


@query(
    "outer_product",
    f"""WITH {CELLS}, {SQUARE}, m AS (SELECT vec_id, p, sum(xb * {weight_sql('j', 'p', 'i')} * xa) AS z FROM sq GROUP BY 1, 2),
    v AS (SELECT vec_id, p, sum(xa * xb * {weight_sql('p', 'i')}) AS z FROM prods GROUP BY 1, 2),
    n AS (SELECT vec_id, p, sum(xa * xb) * {weight_sql('p', '0')} AS z FROM prods GROUP BY 1, 2)
    SELECT vec_id, mat, vec, num FROM (SELECT vec_id, {joined('m', 'p').replace(' FROM', ' AS mat FROM', 1)})
    JOIN (SELECT vec_id, {joined('v', 'p').replace(' FROM', ' AS vec FROM', 1)}) USING (vec_id)
    JOIN (SELECT vec_id, {joined('n', 'p').replace(' FROM', ' AS num FROM', 1)}) USING (vec_id)""",
)
def outer_product(spark, sf):
    n = len(PAIRS)
    out = field_vectors(spark, sf)
    for name, kernel in (("mat", formula(D, n, D)), ("vec", formula(n, D)), ("num", formula(n, 1))):
        out = interact(out, FIELDS, "outer_product", {"kernel": kernel}, name)
    return out.select("vec_id", *[fixed(c).alias(c) for c in ("mat", "vec", "num")])


def _bilinear_sql(name, weight):
    return f"""{name} AS (SELECT vec_id, array_to_string(list({FX.format('z')} ORDER BY p, j), ',') AS {name} FROM
      (SELECT vec_id, p, j, sum(xa * {weight}) * any_value(xb) AS z FROM sqa GROUP BY 1, 2, 3) GROUP BY vec_id)"""


@query(
    "bilinear",
    f"""WITH {CELLS}, sqa AS (SELECT vec_id, p, a, ia.i AS i, ib.i AS j, va[ia.i + 1] AS xa, vb[ib.i + 1] AS xb
      FROM pairs, range(8) ia(i), range(8) ib(i)),
    {_bilinear_sql('shared', weight_sql('i', 'j'))}, {_bilinear_sql('per_field', weight_sql('a', 'i', 'j'))},
    {_bilinear_sql('per_pair', weight_sql('p', 'i', 'j'))}
    SELECT vec_id, shared, per_field, per_pair FROM shared JOIN per_field USING (vec_id) JOIN per_pair USING (vec_id)""",
)
def bilinear(spark, sf):
    out = field_vectors(spark, sf)
    for name, weights in (
        ("shared", {"W": formula(D, D)}),
        ("per_field", {"W": formula(K - 1, D, D), "per": "field"}),
        ("per_pair", {"W": formula(len(PAIRS), D, D)}),
    ):
        out = interact(out, FIELDS, "bilinear", weights, name)
    return out.select("vec_id", *[fixed(c).alias(c) for c in ("shared", "per_field", "per_pair")])


@query(
    "senet",
    f"""WITH {CELLS}, z AS (SELECT vec_id, f, avg(x) AS z FROM cells GROUP BY 1, 2),
    a1 AS (SELECT vec_id, r, greatest(sum(z * {weight_sql('f', 'r')}), 0) AS a FROM z, range(2) t(r) GROUP BY 1, 2),
    a2 AS (SELECT vec_id, g.f AS f, greatest(sum(a * {weight_sql('r', 'g.f')}), 0) AS s FROM a1, range(8) g(f) GROUP BY 1, 2),
    o AS (SELECT vec_id, f, i, x * s AS z FROM cells JOIN a2 USING (vec_id, f))
    SELECT vec_id, {joined('o', 'f, i', 'z * 100').replace(' FROM', ' AS v FROM', 1)}""",
)
def senet(spark, sf):
    out = interact(field_vectors(spark, sf), FIELDS, "senet", {"W1": formula(K, 2), "W2": formula(2, K)}, "v")
    return out.select("vec_id", fixed(F.transform("v", lambda x: x * 100)).alias("v"))


@query(
    "cross_net",
    f"""WITH {CELLS}, x0 AS (SELECT vec_id, f * 8 + i AS d, x FROM cells),
    s0 AS (SELECT vec_id, sum(x * {weight_sql('0', 'd')}) AS s FROM x0 GROUP BY 1),
    x1 AS (SELECT vec_id, d, x, x * s + {weight_sql('0', 'd')} + x AS y FROM x0 JOIN s0 USING (vec_id)),
    s1 AS (SELECT vec_id, sum(y * {weight_sql('1', 'd')}) AS s FROM x1 GROUP BY 1),
    x2 AS (SELECT vec_id, d, x * s + {weight_sql('1', 'd')} + y AS z FROM x1 JOIN s1 USING (vec_id)),
    m1 AS (SELECT vec_id, e.d AS d, sum({weight_sql('e.d', 'x0.d')} * x) AS wx FROM x0, range(64) e(d) GROUP BY 1, 2),
    y1 AS (SELECT vec_id, d, x * (wx + {weight_sql('0', 'd')}) + x AS z FROM x0 JOIN m1 USING (vec_id, d))
    SELECT vec_id, vector, matrix FROM (SELECT vec_id, {joined('x2', 'd').replace(' FROM', ' AS vector FROM', 1)})
    JOIN (SELECT vec_id, {joined('y1', 'd').replace(' FROM', ' AS matrix FROM', 1)}) USING (vec_id)""",
)
def cross_net(spark, sf):
    w = formula(2, K * D)
    out = interact(field_vectors(spark, sf), FIELDS, "cross_net", {"kernels": list(w), "bias": list(w)}, "vector")
    out = interact(out, FIELDS, "cross_net", {"kernels": [formula(K * D, K * D)], "bias": [w[0]]}, "matrix")
    return out.select("vec_id", fixed("vector").alias("vector"), fixed("matrix").alias("matrix"))


@query(
    "afm",
    f"""WITH {CELLS}, pr AS (SELECT vec_id, p, i, xa * xb AS x FROM prods),
    h AS (SELECT vec_id, p, t, greatest(sum(x * {weight_sql('i', 't')}) + 0.01, 0) AS h FROM pr, range(4) r(t) GROUP BY 1, 2, 3),
    e AS (SELECT vec_id, p, exp(sum(h * (t + 1))) AS e FROM h GROUP BY 1, 2),
    a AS (SELECT vec_id, p, e / sum(e) OVER (PARTITION BY vec_id) AS a FROM e)
    SELECT vec_id, round(sum(a * x * (i + 1)), 6) AS z FROM pr JOIN a USING (vec_id, p) GROUP BY vec_id""",
)
def afm(spark, sf):
    weights = {"W": formula(D, 4), "b": np.full(4, 0.01), "h": np.arange(1.0, 5.0), "p": np.arange(1.0, 9.0)}
    out = interact(field_vectors(spark, sf), FIELDS, "afm", weights, "z", scalar=True)
    return out.select("vec_id", F.round("z", 6).alias("z"))


@query(
    "field_bi_interaction",
    f"""WITH {CELLS}, g AS (SELECT vec_id, i, CASE WHEN f < 3 THEN 0 WHEN f < 5 THEN 1 ELSE 2 END AS g, sum(x) AS s, sum(x * x) AS q
      FROM cells GROUP BY ALL),
    fm AS (SELECT vec_id, i, sum((s * s - q) * (g + 1) / 2.0) AS z FROM g GROUP BY 1, 2),
    mf AS (SELECT a.vec_id, a.i, sum(a.s * b.s * (a.g * 5 - a.g * a.g + 2 * b.g) / 10.0) AS z
      FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.i = b.i AND a.g < b.g GROUP BY 1, 2),
    o AS (SELECT vec_id, i, fm.z + mf.z + 0.25 AS z FROM fm JOIN mf USING (vec_id, i))
    SELECT vec_id, {joined('o', 'i').replace(' FROM', ' AS v FROM', 1)}""",
)
def field_bi_interaction(spark, sf):
    groups = [[0, 1, 2], [3, 4], [5, 6, 7]]
    mf = np.array([(a * 5 - a * a + 2 * b) / 10.0 for a, b in combinations(range(3), 2)])
    weights = {"groups": groups, "mf": mf, "fm": np.array([0.5, 1.0, 1.5]), "bias_mf": np.full(D, 0.25)}
    out = interact(field_vectors(spark, sf), FIELDS, "field_bi_interaction", weights, "v")
    return out.select("vec_id", fixed("v").alias("v"))


@query(
    "mix_experts",
    f"""WITH {field_vectors_sql()}, g AS (SELECT *, [exp(x) for x in f7] AS e, [f0, f1, f2, f3, f4, f5, f6, f7] AS v FROM fields)
    SELECT vec_id, array_to_string([CAST(round(list_sum([e[k] * v[k][i] for k in range(1, 9)]) / list_sum(e) * 1e6) AS BIGINT) for i in range(1, 9)], ',') AS v,
    round(list_sum([e[k] / (1 + exp(-f6[k])) for k in range(1, 9)]) / list_sum(e), 6) AS pieces FROM g""",
)
def mix_experts(spark, sf):
    """Eight experts mixed by a gate of eight numbers; eight learners, each in the share of its region."""
    return field_vectors(spark, sf).select(
        "vec_id",
        fixed(S.mix_experts("f7", [f"f{i}" for i in range(8)])).alias("v"),
        F.round(S.piecewise_linear("f7", "f6"), 6).alias("pieces"),
    )


def _alternating(x, w):
    """A cross of the caller's own: neighbouring fields' products with signs that alternate."""
    return ((x[:, :-1] * x[:, 1:]).sum(2) * w["signs"]).sum(1, keepdims=True)


@query(
    "hook_cross",
    f"WITH {field_vectors_sql()} SELECT vec_id, round("
    + " ".join(f"{'-' if i % 2 else '+'} list_dot_product(f{i}, f{i + 1})" for i in range(K - 1))
    + ", 6) AS cross FROM fields",
)
def hook_cross(spark, sf):
    signs = np.array([(-1.0) ** i for i in range(K - 1)])
    out = interact(field_vectors(spark, sf), FIELDS, _alternating, {"signs": signs}, scalar=True)
    return out.select("vec_id", F.round("cross", 6).alias("cross"))
