"""Order, sampling, splitting and batching of rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ranking import global_rank
from clickloom.storage import materialize

DATE_FORMAT = "%Y%m%d"


def get_date(days: int, base: str, fmt: str = DATE_FORMAT, base_fmt: str | None = None) -> str:
    """``base`` shifted by ``days``."""
    return (dt.datetime.strptime(base, base_fmt or fmt) + dt.timedelta(days=days)).strftime(fmt)


def date_list(start: str, end: str, end_include: bool = False, step: int = 1, fmt: str = DATE_FORMAT) -> list[str]:
    """Dates from ``start`` towards ``end``; the end counts only on request."""
    if step == 0:
        raise ValueError("step must not be 0")
    first = dt.datetime.strptime(start, fmt)
    span = (dt.datetime.strptime(end, fmt) - first).days
    stop = span + (1 if step > 0 else -1) if end_include else span
    return [(first + dt.timedelta(days=i)).strftime(fmt) for i in range(0, stop, step)]


def date_range_table(bounds: DataFrame, start: str, end: str, step: int = 1, end_include: bool = False) -> DataFrame:
    """One row per date between two date columns of each row of ``bounds``."""
    stop = F.col(end) if end_include else F.date_sub(F.col(end), 1)
    days = F.when(
        stop >= F.col(start), F.sequence(F.col(start), stop, F.expr(f"interval {int(step)} days"))
    )
    return bounds.select(F.explode(days).alias("day")).select(F.date_format("day", "yyyyMMdd").alias("dt"))


def hash_order(key: Sequence[str], seed: int = 0) -> Column:
    """A repeatable random order: depends on the row's key, not on partitioning."""
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in key])


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(key, seed), *key)


#: Bits of a sampling number, and of them decided by one pass.
HASH_BITS, PASS_BITS = 60, 12


def hash_number(key: Sequence[str], seed: int = 0) -> Column:
    """A number of 60 bits for a row's key: the head of the md5 of seed and key, so any engine can check it."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def cut_off(numbers: DataFrame, column: str, n: int) -> tuple[int, int]:
    """(cut, rest): n rows are those below ``cut`` and ``rest`` of those equal to it.

    Histogram passes: each counts the next bits of the numbers that share the
    bits found so far, at most 4096 counts, until the n-th smallest is known.
    """
    low, rest = 0, n
    for shift in range(HASH_BITS - PASS_BITS, -1, -PASS_BITS):
        inside = numbers.where((F.col(column) >= low) & (F.col(column) < low + (1 << shift + PASS_BITS)))
        counts = inside.groupBy(F.shiftright(F.col(column) - low, shift).alias("cell")).count().collect()
        for cell, count in sorted((r["cell"], r["count"]) for r in counts):
            if rest <= count:
                break
            rest -= count
        else:  # fewer than n rows
            return 1 << HASH_BITS, 0
        low += cell << shift
    return low, rest


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` random rows (all, if there are fewer), in as many tasks as the table has.

    The rows with the smallest ``hash_number``; only rows whose number equals the
    cut-off, copies of one key, are ranked to reach n exactly.
    """
    if n <= 0:
        return df.limit(0)
    numbers = materialize(df.select(hash_number(key, seed).alias("_h")), "sample-numbers")
    cut, rest = cut_off(numbers, "_h", n)
    named = df.withColumn("_h", hash_number(key, seed))
    below = named.where(F.col("_h") < cut).drop("_h")
    if not rest:
        return below
    ties = named.where(F.col("_h") == cut).drop("_h")
    if numbers.where(F.col("_h") == cut).count() > rest:
        ties = global_rank(ties, [F.col(k).asc() for k in key], out="_rn").where(F.col("_rn") <= rest).drop("_rn")
    return below.unionByName(ties)


def sort_counts(counts: DataFrame, value: str = "value", count: str = "count") -> DataFrame:
    return counts.orderBy(F.col(count).desc(), F.col(value).asc())


def count_values(df: DataFrame, col: str, sort: bool = True) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return sort_counts(counts) if sort else counts


def split_prefix(df: DataFrame, ratio: float, order: Sequence[Column], by: Sequence[str] = (), out: str = "side") -> DataFrame:
    """First ``int(n * ratio)`` rows of every group are 'left', the rest 'right'."""
    ranked = global_rank(df, order, by, "_rn")
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n")
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        joined = ranked.join(sizes, on)
    else:
        joined = ranked.withColumn("_n", sizes.scalar())
    left = F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(ratio)))
    return joined.select(*df.columns, F.when(left, "left").otherwise("right").alias(out))


def split_timeline(
    df: DataFrame,
    day: str,
    n_days: int,
    order: Sequence[Column] | None = None,
    key: Sequence[str] = (),
    ratio: float = 0.7,
    out: str = "split",
) -> DataFrame:
    """Leak-free split by date.

    Train = the days ``day-n .. day-2`` plus the first part of ``day-1`` and of
    ``day``; dev = the rest of ``day-1``; test = the rest of ``day``.  The part
    is a prefix along ``order``, or a hash of ``key`` when no order is given.
    """
    before, start = get_date(-1, day), get_date(-n_days, day)
    past = df.where(F.col("dt").between(start, get_date(-2, day))).withColumn(out, F.lit("train"))
    recent = df.where(F.col("dt").isin(before, day))
    if order is not None:
        sided = split_prefix(recent, ratio, order, by=["dt"], out="_side")
        is_left = F.col("_side") == "left"
    else:
        sided = recent.withColumn("_side", F.pmod(hash_order(key), F.lit(1 << 52)) < F.lit(int(ratio * (1 << 52))))
        is_left = F.col("_side")
    name = F.when(is_left, "train").when(F.col("dt") == before, "dev").otherwise("test")
    return past.unionByName(sided.withColumn(out, name).drop("_side"))


def split_simple(df: DataFrame, day: str, n_days: int, out: str = "split") -> DataFrame:
    """Train = ``[day - n, day)``; dev and test are both ``day``; one pass over ``df``."""
    sides = F.when(F.col("dt") == day, F.array(F.lit("dev"), F.lit("test"))).otherwise(F.array(F.lit("train")))
    return df.where(F.col("dt").between(get_date(-n_days, day), day)).withColumn(out, F.explode(sides))


def union_splits(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_rows(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = (), out: str = "batch") -> DataFrame:
    """Consecutive batches of ``n`` rows inside each group."""
    ranked = global_rank(df, order, by, "_rn")
    return ranked.withColumn(out, F.floor((F.col("_rn") - 1) / n).cast("long")).drop("_rn")


def repeat_epochs(df: DataFrame, epochs: int, out: str = "epoch") -> DataFrame:
    """Every row once per epoch, without a join."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
