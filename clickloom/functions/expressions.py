"""Feature expressions: functions from Columns to a Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(c):
    return c if isinstance(c, Column) else F.lit(c)


def identity(name: str) -> Column:
    return F.col(name)


def get_map_values(m, keys: Sequence) -> Column:
    """Vector of the values of ``keys`` in that order, 0 where a key is absent."""
    return F.array(*[map_value(m, k) for k in keys])


def map_value(m, key) -> Column:
    return F.coalesce(F.element_at(_col(m), F.lit(key)).cast("float"), F.lit(0).cast("float"))


def concat_ws(arr, sep: str = ",") -> Column:
    return F.concat_ws(sep, _col(arr))


def hour(ts) -> Column:
    """Hour of the row's event time (not the wall clock, so a re-run agrees)."""
    return F.hour(_col(ts))


def weekday(ts) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(_col(ts))


def batch_const(value) -> Column:
    return F.lit(value)


def if_equal(a, b, then, otherwise) -> Column:
    return F.when(_col(a) == _lit(b), _lit(then)).otherwise(_lit(otherwise))


def time_count(ref, ts, unit: str = "d") -> Column:
    """Whole days (``d``) or hours (``h``) from ``ts`` to ``ref``; NULL or zero times give 0."""
    if unit == "d":
        n = F.datediff(F.to_date(_col(ref)), F.to_date(_col(ts)))
    elif unit == "h":
        n = F.floor(elapsed_seconds(ref, ts) / 3600).cast("int")
    else:
        raise ValueError(f"unknown time unit {unit!r}")
    return F.coalesce(n, F.lit(0))


def elapsed_seconds(ref, ts) -> Column:
    to_seconds = lambda c: F.unix_timestamp(_col(c).cast("timestamp"))
    return to_seconds(ref) - to_seconds(ts)


def as_string(c) -> Column:
    return _col(c).cast("string")


def last_segment(c, sep: str = ".") -> Column:
    return F.substring_index(_col(c), sep, -1)


def same(a, b) -> Column:
    """1 when equal, else 0; a missing side is not equal to anything."""
    return F.coalesce((_col(a) == _col(b)).cast("int"), F.lit(0))


def abs_diff(a, b) -> Column:
    return F.abs(_col(a) - _col(b))
