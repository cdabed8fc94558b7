"""Weight-free feature crosses over k field vectors of equal length."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions import vectors as V


def _sum_vectors(vs: Sequence[Column]) -> Column:
    out = vs[0]
    for v in vs[1:]:
        out = V.add(out, v)
    return out


def bi_interaction(fields: Sequence) -> Column:
    """``0.5 * ((sum v)^2 - sum v^2)`` per dimension: linear in the number of fields."""
    vs = [V.doubles(f) for f in fields]
    s = _sum_vectors(vs)
    q = _sum_vectors([F.transform(v, lambda x: x * x) for v in vs])
    return F.zip_with(s, q, lambda a, b: (a * a - b) * 0.5)


def fm_second_order(fields: Sequence) -> Column:
    return V.total(bi_interaction(fields))


def fm_grouped(groups: Mapping[str, Sequence]) -> Column:
    """Second-order term of every named group, summed; one-field groups add nothing."""
    out = F.lit(0.0)
    for fields in groups.values():
        out = out + fm_second_order(fields)
    return out


def inner_product(fields: Sequence, reduce: bool = True) -> Column:
    """Per pair (i < j): the dot product, or the element-wise product."""
    pairs = combinations(fields, 2)
    return F.array(*[V.dot(a, b) if reduce else V.multiply(a, b) for a, b in pairs])


def fwfm(fields: Sequence, strength: Sequence[Sequence[float]]) -> Column:
    """Sum of pair dot products times the strength of the pair."""
    out = F.lit(0.0)
    for (i, a), (j, b) in combinations(list(enumerate(fields)), 2):
        out = out + V.dot(a, b) * F.lit(float(strength[i][j]))
    return out
