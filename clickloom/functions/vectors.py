"""Arithmetic on ``array<double>`` Columns, inside whole-stage expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it, as a lambda variable, inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def scale(v, w) -> Column:
    return F.transform(doubles(v), lambda x: x * w)


def add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def multiply(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has length zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.when(_col(a).isNotNull() & _col(b).isNotNull(), F.lit(0.0)))


def cosine_halves(v, size: int) -> Column:
    """Cosine of the first and the second ``size`` elements of one vector."""
    return cosine(F.slice(_col(v), 1, size), F.slice(_col(v), size + 1, size))


def str_to_vec(c, dim: int, sep: str = ",", kind: str = "float") -> Column:
    """Parse ``"0.1,0.2"``; raises on a vector of another length."""
    if kind not in ("float", "int"):
        raise ValueError("kind must be float or int")
    parts = F.split(_col(c), re.escape(sep))
    vec = F.transform(parts, lambda t: F.trim(t).try_cast(kind))
    return F.when(
        _col(c).isNotNull() & F.assert_true(F.size(parts) == dim, F.lit(f"vector length is not {dim}")).isNull(), vec
    )


def softmax(v) -> Column:
    shifted = let(doubles(v), lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def layer_norm(v, eps: float = 1e-9) -> Column:
    centered = let(
        doubles(v), lambda a: let(total(a) / F.size(a), lambda mean: F.transform(a, lambda x: x - mean))
    )
    return let(
        centered,
        lambda c: let(
            F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + F.lit(eps)),
            lambda std: F.transform(c, lambda x: x / std),
        ),
    )


def concat(*vs) -> Column:
    """Vectors and plain numbers joined to one vector."""
    return F.concat(*[doubles(v) for v in vs])


def position_angles(pos: Column, dim: int, scaled: bool = True) -> Column:
    """Sine (even places) and cosine (odd places) table row for one position."""
    factor = math.sqrt(dim) if scaled else 1.0
    cells = []
    for i in range(dim):
        angle = pos.cast("double") / F.lit(math.pow(10000.0, 2.0 * (i // 2) / dim))
        cells.append((F.sin(angle) if i % 2 == 0 else F.cos(angle)) * F.lit(factor))
    return F.array(*cells)


def position_encoding(seq, dim: int, scaled: bool = True, zero_pad: bool = False) -> Column:
    """Add the position table to ``array<array<double>>``, step 0 first."""

    def step(v, i):
        row = position_angles(i, dim, scaled)
        if zero_pad:
            row = F.when(i == 0, zeros(dim)).otherwise(row)
        return add(v, row)

    return F.transform(_col(seq).cast("array<array<double>>"), step)
