"""Numeric transforms as Columns.

Two generations of formulas share names; the second one is spelled ``*_v2``.
Parameters are plain numbers or Columns (for instance fitted statistics joined
to the row).  Everything is computed in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions import vectors as V

Number = float | int


def _num(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def to_float(x):
    return (F.col(x) if isinstance(x, str) else x).cast("float")


def identity(x):
    return F.col(x) if isinstance(x, str) else x


def add(x, c: Number):
    return _num(x) + F.lit(float(c))


def divide(x, c: Number):
    if c == 0:
        raise ValueError("divide needs a divisor other than 0")
    return _num(x) / F.lit(float(c))


def sqrt(x):
    return F.sqrt(_num(x))


def clip(x, lo: Number, hi: Number):
    v = _num(x)
    return F.when(v.isNull(), v).otherwise(F.greatest(F.least(v, F.lit(float(hi))), F.lit(float(lo))))


def normal(x, mean: Number, std: Number):
    if std == 0:
        raise ValueError("normal needs a standard deviation other than 0")
    return (_num(x) - F.lit(float(mean))) / F.lit(float(std))


def min_max(x, lo: Number, hi: Number):
    """First generation: only the pair (0, 0) is refused; equal bounds give NULL."""
    if lo == 0 and hi == 0:
        raise ValueError("min_max needs bounds that are not both 0")
    return F.try_divide(_num(x) - F.lit(float(lo)), F.lit(float(hi) - float(lo)))


def min_max_v2(x, lo: Number, hi: Number):
    if not hi > lo:
        raise ValueError("min_max needs max > min")
    return (_num(x) - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def log(x):
    return F.ln(F.abs(_num(x)) + 1)


def log_v2(x, base: Number | None = None):
    v = F.ln(_num(x) + 1)
    return v / F.lit(math.log(base)) if base and base > 0 else v


def log_normal(x, mean: Number, std: Number):
    if std == 1:
        raise ValueError("log_normal divides by ln(std): std must not be 1")
    if std < 0 or mean < 0:
        raise ValueError("log_normal takes logarithms of mean and std: they must not be negative")
    ln = lambda v: math.log(v) if v > 0 else float("-inf")
    return (F.ln(F.abs(_num(x)) + 1) - F.lit(ln(mean))) / F.lit(ln(std))


def log_normal_v2(x, log_mean: Number, log_std: Number):
    """``(ln(x + 1) - log_mean) / log_std``.

    The two parameters are fitted on ``ln(x)``, not ``ln(x + 1)``; that
    mismatch is part of the definition and is kept.
    """
    if log_std == 0:
        raise ValueError("log_normal needs a log deviation other than 0")
    return (F.ln(_num(x) + 1) - F.lit(float(log_mean))) / F.lit(float(log_std))


def ratio(v, c: Number):
    """Smoothed share of each element of a vector."""
    v = F.col(v) if isinstance(v, str) else v
    shifted = F.transform(v, lambda e: e.cast("double") + F.lit(float(c)))
    return V.let(shifted, lambda a: V.let(V.total(a), lambda s: F.transform(a, lambda e: F.try_divide(e, s))))


def bucketize(x, bounds: list[float]):
    """Number of boundaries that are <= x (0 .. len(bounds)); NULL stays NULL."""
    v = _num(x)
    if list(bounds) != sorted(bounds):
        raise ValueError("bounds must be ascending")
    rank = F.lit(0)
    for b in bounds:
        rank = rank + (v >= F.lit(float(b))).cast("int")
    return rank


FIRST_GENERATION = ("normal", "min_max", "log", "log_normal", "donothing")
SECOND_GENERATION = ("normal", "min_max", "log", "log_normal", "ratio")


def by_name(op: str, x, p=None, q=None, generation: int = 2) -> Column:
    """Pick a transform by its name in a feature specification."""
    one = {
        "normal": lambda: normal(x, p, q),
        "min_max": lambda: min_max(x, p, q),
        "log": lambda: log(x),
        "log_normal": lambda: log_normal(x, p, q),
        "donothing": lambda: _num(x),
        "sqrt": lambda: sqrt(x),
        "clip_by_value": lambda: clip(x, p, q),
    }
    two = {
        "normal": lambda: normal(x, p, q),
        "min_max": lambda: min_max_v2(x, p, q),
        "log": lambda: log_v2(x, p),
        "log_normal": lambda: log_normal_v2(x, p, q),
        "ratio": lambda: ratio(x, p),
        "add": lambda: add(x, p),
        "divide": lambda: divide(x, p),
        "sqrt": lambda: sqrt(x),
        "clip_by_value": lambda: clip(x, p, q),
    }
    table = one if generation == 1 else two
    if op not in table:
        raise ValueError(f"unknown dense transform {op!r} in generation {generation}")
    try:
        return table[op]()
    except TypeError as e:
        raise ValueError(f"dense transform {op!r} misses a parameter: {p!r}, {q!r}") from e
