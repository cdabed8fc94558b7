"""Trailing-window features.

The value served on day ``d`` covers ``[d - n, d - 1]``: a row never sees its
own day.  Events are first added up per (key, day) with map-side combining, so
the window that follows holds at most one row per day and key however hot the
key is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.storage import materialize

#: Seconds of one slice of a key's time.
SLICE_SECONDS = 7 * 86_400


def day_number(ts) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(F.col(ts) if isinstance(ts, str) else ts))


def daily(df: DataFrame, keys: Sequence[str], day: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per (keys, day) with the given aggregates."""
    return df.groupBy(*keys, day).agg(*[c.alias(n) for n, c in measures.items()])


def over_days(keys: Sequence[str], day: str, n: int):
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(-n, -1)


def trailing_sum(keys: Sequence[str], day: str, measure: str, n: int) -> Column:
    return F.coalesce(F.sum(measure).over(over_days(keys, day, n)), F.lit(0))


def trailing_counts(table: DataFrame, keys, day: str, measures: Sequence[str], days: Sequence[int]) -> DataFrame:
    """``<measure>_<n>d`` for every measure and window length."""
    return table.withColumns(
        {f"{m}_{n}d": trailing_sum(keys, day, m, n) for m in measures for n in days}
    )


def trailing_ratio(keys, day: str, part: str, whole: str, n: int) -> Column:
    """Ratio of two trailing sums; NULL when there is nothing to divide by."""
    return F.try_divide(trailing_sum(keys, day, part, n), trailing_sum(keys, day, whole, n))


def lifetime(keys, day: str, measure: str) -> Column:
    """Total of all earlier days."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(measure).over(w), F.lit(0))


def trailing_distinct(df: DataFrame, keys: Sequence[str], member: str, day: str, n: int, out: str) -> DataFrame:
    """Distinct members seen in the window, for every day the key is active.

    A member seen on day ``a`` and next on day ``b`` counts on the days
    ``a+1 .. min(a+n, b)``.  That is +1 at the start and -1 after the end; a
    running total of these steps per key gives the distinct count.  Two rows per
    sighting instead of n, and members of a hot key spread over all tasks.
    """
    seen = df.select(*keys, member, day).where(F.col(member).isNotNull()).distinct()
    again = F.lead(day).over(Window.partitionBy(*keys, member).orderBy(day))
    last = F.least(F.col(day) + n, F.coalesce(F.col("_again"), F.col(day) + n))
    steps = seen.withColumn("_again", again).select(
        *keys,
        F.explode(
            F.array(
                F.struct((F.col(day) + 1).alias("d"), F.lit(1).alias("step"), F.lit(0).alias("active")),
                F.struct((last + 1).alias("d"), F.lit(-1).alias("step"), F.lit(0).alias("active")),
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    active = df.select(*keys, F.col(day).alias("d"), F.lit(0).alias("step"), F.lit(1).alias("active"))
    per_day = (
        steps.unionByName(active)
        .groupBy(*keys, "d")
        .agg(F.sum("step").alias("step"), F.max("active").alias("active"))
    )
    running = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_day.withColumn(out, F.sum("step").over(running))
        .where(F.col("active") == 1)
        .select(*keys, F.col("d").alias(day), out)
    )


def trailing_active_days(df: DataFrame, keys, day: str, n: int, out: str) -> DataFrame:
    """Days with at least one event inside the window."""
    days = df.groupBy(*keys, day).agg(F.lit(1).alias("_one"))
    return days.select(*keys, day, trailing_sum(keys, day, "_one", n).alias(out))


def ratio_intervals(table: DataFrame, owner: str, item: str, day: str, part: str, whole: str, n: int) -> DataFrame:
    """(owner, lo, hi, ratio): the serving days lo to hi on which an item's trailing ratio stays the same.

    A daily row enters the window the day after and leaves it n days later, so
    running sums over these two steps change on their days only.  Days without
    any row in the window are in no interval; ratio is NULL where whole is 0.
    """
    steps = table.select(
        owner, item,
        F.explode(F.array(
            F.struct((F.col(day) + 1).alias("lo"), F.col(part).alias("p"), F.col(whole).alias("w"), F.lit(1).alias("rows")),
            F.struct((F.col(day) + n + 1).alias("lo"), (-F.col(part)).alias("p"), (-F.col(whole)).alias("w"), F.lit(-1).alias("rows")),
        )).alias("s"),
    ).select(owner, item, "s.*")
    changes = steps.groupBy(owner, item, "lo").agg(*[F.sum(c).alias(c) for c in ("p", "w", "rows")])
    at = Window.partitionBy(owner, item).orderBy("lo")
    running = at.rowsBetween(Window.unboundedPreceding, 0)
    return (
        changes.select(owner, "lo", (F.lead("lo").over(at) - 1).alias("hi"), *[F.sum(c).over(running).alias(c) for c in ("p", "w", "rows")])
        .where("rows > 0")
        .select(owner, "lo", "hi", F.try_divide("p", "w").alias("ratio"))
    )


def interval_maximum(intervals: DataFrame, owner: str, longest: int) -> DataFrame:
    """(owner, lo, largest): per day the largest ratio of the intervals (lo, hi) that hold it, none longer than ``longest``.

    A sparse table over time: the two largest power-of-two blocks inside an
    interval cover it, equal blocks of an owner are combined, and each level
    hands its maximum to the two halves below, down to single days.
    """
    top = max(longest, 1).bit_length() - 1
    length = F.col("hi") - F.col("lo") + 1
    level = sum((F.when(length >= 1 << k, 1).otherwise(0) for k in range(1, top + 1)), F.lit(0))
    block = F.call_function("shiftleft", F.lit(1), level)
    starts = F.array_distinct(F.array("lo", (F.col("hi") - block + 1).cast("int")))
    blocks = intervals.select(owner, level.alias("level"), F.explode(starts).alias("lo"), "ratio")
    blocks = blocks.groupBy(owner, "level", "lo").agg(F.max("ratio").alias("ratio"))
    found = blocks.where(F.col("level") == top).drop("level")
    for k in range(top - 1, -1, -1):
        halves = found.select(owner, F.explode(F.array("lo", F.col("lo") + (1 << k))).alias("lo"), "ratio")
        own = blocks.where(F.col("level") == k).select(owner, "lo", "ratio")
        found = halves.union(own).groupBy(owner, "lo").agg(F.max("ratio").alias("ratio"))
    return found.withColumnRenamed("ratio", "largest")


def interval_mean(intervals: DataFrame, owner: str) -> DataFrame:
    """(owner, lo, mean): per day the mean ratio of the intervals that hold it.

    Ratios enter and leave running sums as decimals, so that what has left
    leaves nothing behind.
    """
    ratio = F.col("ratio").cast("decimal(38,18)")
    known = F.col("ratio").isNotNull().cast("int")
    steps = intervals.select(owner, F.explode(F.array(
        F.struct(F.col("lo"), ratio.alias("s"), known.alias("n"), F.lit(1).alias("alive")),
        F.struct((F.col("hi") + 1).alias("lo"), (-ratio).alias("s"), (-known).alias("n"), F.lit(-1).alias("alive")),
    )).alias("x")).select(owner, "x.*")
    per_day = steps.groupBy(owner, "lo").agg(*[F.sum(c).alias(c) for c in ("s", "n", "alive")])  # at most one row a day
    at = Window.partitionBy(owner).orderBy("lo")
    running = at.rowsBetween(Window.unboundedPreceding, 0)
    pieces = per_day.select(owner, "lo", (F.lead("lo").over(at) - 1).alias("hi"), *[F.sum(c).over(running).alias(c) for c in ("s", "n", "alive")])
    mean = F.try_divide(F.col("s").cast("double"), F.col("n")).alias("mean")
    return pieces.where("alive > 0").select(owner, F.explode(F.sequence("lo", "hi")).alias("lo"), mean)


def trailing_best_ratio(
    table: DataFrame, owner: str, item: str, day: str, part: str, whole: str, n: int
) -> DataFrame:
    """Per owner and serving day: largest and mean item ratio over the window.

    ``table`` is one row per (owner, item, day).  No row is copied to the days it
    serves: an item's ratio is constant between the days something enters or
    leaves, and these intervals (at most two a row) are what is shuffled.
    """
    intervals = materialize(ratio_intervals(table, owner, item, day, part, whole, n), "ratio-intervals")
    best = interval_maximum(intervals, owner, n)
    mean = interval_mean(intervals, owner).withColumnRenamed(owner, "_owner").withColumnRenamed("lo", "_lo")
    both = best.join(mean, F.col(owner).eqNullSafe(F.col("_owner")) & (F.col("lo") == F.col("_lo")))
    return both.select(owner, F.col("lo").alias(day), F.col("largest").alias("max_ratio"), F.col("mean").alias("avg_ratio"))


def trailing_hours(
    df: DataFrame, keys: Sequence[str], second: str, hours: int, measures: Mapping[str, Column], slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Sums over the ``hours`` before each second the key is active in.

    Rows are per (key, second) and a key is cut into slices of time; the last
    ``hours`` of a slice are handed to the next one as well.  No window holds
    more rows than a slice and its overlap have seconds, however hot the key.
    """
    span = hours * 3600
    width = max(span, slice_seconds)
    own = F.floor(F.col(second) / width)
    parts = F.when(F.col(second) + span >= (own + 1) * width, F.array(own, own + 1)).otherwise(F.array(own))
    sliced = daily(df, keys, second, measures).select("*", own.alias("_own"), F.explode(parts).alias("_slice"))
    w = Window.partitionBy(*keys, "_slice").orderBy(second).rangeBetween(-span, -1)
    sums = {f"{m}_{hours}h": F.coalesce(F.sum(m).over(w), F.lit(0)) for m in measures}
    return sliced.withColumns(sums).where("_own = _slice").select(*keys, second, *sums)


def declared_counts(key_col: str, keys: Sequence) -> dict[str, Column]:
    """Count aggregate for each declared key of a map feature."""
    return {f"_k{i}": F.count_if(F.col(key_col) == F.lit(k)) for i, k in enumerate(keys)}


def trailing_map(df: DataFrame, by: Sequence[str], key_col: str, keys: Sequence, day: str, n: int, out: str) -> DataFrame:
    """Map of declared key -> trailing count; keys that were not seen are absent."""
    table = daily(df, by, day, declared_counts(key_col, keys))
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("key"), trailing_sum(by, day, f"_k{i}", n).alias("value"))
            for i, k in enumerate(keys)
        ]
    )
    return table.withColumn("_pairs", pairs).select(
        *by, day, F.map_from_entries(F.filter("_pairs", lambda p: p["value"] > 0)).alias(out)
    )


def trailing_bins(df: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float], day: str, n: int, out: str) -> DataFrame:
    """Vector of trailing counts per value bin (``len(bounds) + 1`` bins)."""
    edges = [None, *bounds, None]
    x = F.col(value)
    conds = []
    for lo, hi in zip(edges, edges[1:]):
        c = x.isNotNull()
        c = c if lo is None else c & (x >= lo)
        conds.append(c if hi is None else c & (x < hi))
    table = daily(df, by, day, {f"_b{i}": F.count_if(c) for i, c in enumerate(conds)})
    return table.select(
        *by, day, F.array(*[trailing_sum(by, day, f"_b{i}", n) for i in range(len(conds))]).alias(out)
    )


def smooth_ratio(pos, n, a: float = 1.0) -> Column:
    """``(pos + a) / (n + 2a)``: 0.5 without any evidence."""
    p = F.col(pos) if isinstance(pos, str) else pos
    w = F.col(n) if isinstance(n, str) else n
    return (p + F.lit(a)) / (w + F.lit(2 * a))


def smoothed_rate(clicks, views, a: float = 1.0, b: float = 5.0) -> Column:
    """Click rate with prior ``a / (a + b)`` (1/6)."""
    c = F.col(clicks) if isinstance(clicks, str) else clicks
    v = F.col(views) if isinstance(views, str) else views
    return (c + F.lit(a)) / (v + F.lit(a + b))


def preference_odds(clicks_a, views_a, clicks_b, views_b) -> Column:
    """Ratio of two smoothed click rates: 1 without any evidence."""
    return smoothed_rate(clicks_a, views_a) / smoothed_rate(clicks_b, views_b)


def first_position(df: DataFrame, keys: Sequence[str], position: str, top: int = 299) -> DataFrame:
    """Smallest shown position per key, clipped to ``0 .. top``."""
    return df.groupBy(*keys).agg(
        F.greatest(F.lit(0), F.least(F.lit(top), F.min(position))).cast("int").alias("min_position_id")
    )
