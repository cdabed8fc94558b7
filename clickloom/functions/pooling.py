"""Pooling of a looked-up sequence ``array<array<double>>`` with a 0/1 mask."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions import vectors as V

EPS_V1 = 1e-8
EPS_V2 = 1e-6


def _seq(c) -> Column:
    return V._col(c).cast("array<array<double>>")


def _mask(c) -> Column:
    return V._col(c).cast("array<double>")


def _steps(seq, weight) -> Column:
    """Sum of step vectors times their weights is built from these pairs."""
    return F.zip_with(_seq(seq), _mask(weight), lambda v, w: F.struct(v.alias("v"), w.alias("w")))


def weighted_sum(seq, weight, dim: int) -> Column:
    return F.aggregate(
        _steps(seq, weight), V.zeros(dim), lambda acc, s: F.zip_with(acc, s["v"], lambda a, x: a + x * s["w"])
    )


def pool_sum(seq, mask, dim: int) -> Column:
    return weighted_sum(seq, mask, dim)


def pool_mean(seq, mask, dim: int, eps: float = EPS_V2) -> Column:
    return V.let(
        V.total(_mask(mask)) + F.lit(eps), lambda n: F.transform(pool_sum(seq, mask, dim), lambda x: x / n)
    )


def pool_max(seq, mask, dim: int) -> Column:
    """Masked steps are lowered by 1e9, so an empty sequence gives about -1e9."""
    lowest = F.array_repeat(F.lit(float("-inf")), dim)
    return F.aggregate(
        _steps(seq, mask),
        lowest,
        lambda acc, s: F.zip_with(acc, s["v"], lambda a, x: F.greatest(a, x - (1 - s["w"]) * F.lit(1e9))),
    )


def step_weights(weight, mask, normalize: bool = True) -> Column:
    """Weights of the unmasked steps; with ``normalize`` their softmax."""
    off = F.lit(float(-(2**32) + 1) if normalize else 0.0)
    kept = F.zip_with(_mask(weight), _mask(mask), lambda w, m: F.when(m != 0, w).otherwise(off))
    return V.softmax(kept) if normalize else kept


def pool_weighted(seq, weight, mask, dim: int, normalize: bool = True) -> Column:
    return weighted_sum(seq, step_weights(weight, mask, normalize), dim)


def pool_weighted_average(seq, weight, dim: int, eps: float = EPS_V2) -> Column:
    return V.let(
        V.total(_mask(weight)) + F.lit(eps), lambda n: F.transform(weighted_sum(seq, weight, dim), lambda x: x / n)
    )


def pool_attention_dot(seq, query, mask, dim: int) -> Column:
    """Scaled dot-product weights; a masked score is 1e-12, not minus infinity."""
    q = V.doubles(query)
    scores = F.zip_with(
        _seq(seq),
        _mask(mask),
        lambda v, m: F.when(m != 0, V.dot(v, q) / F.lit(math.sqrt(dim))).otherwise(F.lit(1e-12)),
    )
    return weighted_sum(seq, V.softmax(scores), dim)


def pool(kind: str, seq, mask, dim: int, weight=None, query=None, eps: float = EPS_V2) -> Column:
    """Pick a combiner by its name in a specification."""
    if kind == "sum":
        return pool_sum(seq, mask, dim)
    if kind in ("mean", "avg"):
        return pool_mean(seq, mask, dim, eps)
    if kind == "max":
        return pool_max(seq, mask, dim)
    if kind == "weighted_average":
        return pool_weighted_average(seq, weight, dim, eps)
    if kind == "weighted":
        return pool_weighted(seq, weight, mask, dim)
    if kind == "attention_dot":
        return pool_attention_dot(seq, query, mask, dim)
    raise ValueError(f"unknown combiner {kind!r}")


def pool_concat(kinds, seq, mask, dim: int, **extra) -> Column:
    """Several combiners of the same sequence side by side, each on the raw input."""
    return F.concat(*[pool(k, seq, mask, dim, **extra) for k in kinds])


def pool_by_group(fields, seqs, masks, dim: int, weights=None, queries=None) -> dict[str, Column]:
    """Pool every token feature with its own combiner; one array of vectors per group.

    ``fields`` carry ``name``, ``pooling`` and ``group``; the mappings give the
    Columns of each feature by name.
    """
    groups: dict[str, list[Column]] = {}
    for f in fields:
        pooled = pool(
            f.pooling, seqs[f.name], masks[f.name], dim, (weights or {}).get(f.name), (queries or {}).get(f.name)
        )
        groups.setdefault(f.group, []).append(pooled)
    return {g: F.array(*cols) for g, cols in groups.items()}
