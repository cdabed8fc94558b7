"""Equal-mass value bands: the unit in which ordered totals are summed.

A running total over all rows in value order would need one task for the whole
table (or for a hot user).  Cutting the value axis at approximate quantiles
gives bands of similar mass whatever the distribution; totals per band are few,
and the exact order matters only inside a band.  The cut points decide balance
only, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_points(df: DataFrame, cols: Sequence[str], bands: int | None = None) -> dict[str, list[float]]:
    """Strictly increasing band edges per column.

    There are as many bands as the session has shuffle partitions, unless their
    number is given: the one setting that is made for the size of the data.
    """
    wanted = bands or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts: dict[str, list[float]] = {c: [] for c in cols}
    if wanted > 1:
        probs = F.expr("array(" + ", ".join(f"{i / wanted!r}D" for i in range(1, wanted)) + ")")
        sketch = df.agg(*[F.percentile_approx(c, probs, max(100, 2 * wanted)).alias(c) for c in cols]).first()
        cuts = {c: sorted({q for q in sketch[c] or [] if math.isfinite(q)}) for c in cols}
    return {c: [float("-inf"), *inner, float("inf")] for c, inner in cuts.items()}


def add_bands(df: DataFrame, edges: Mapping[str, Sequence[float]], suffix: str = "_band") -> DataFrame:
    """Add the band number of every column in ``edges`` (binary search in the JVM)."""
    single = [c for c in edges if len(edges[c]) < 3]  # everything in one band
    df = df.withColumns({c + suffix: F.lit(0.0) for c in single})
    cols = [c for c in edges if c not in single]
    if not cols:
        return df
    return Bucketizer(
        splitsArray=[list(edges[c]) for c in cols],
        inputCols=cols,
        outputCols=[c + suffix for c in cols],
        handleInvalid="keep",
    ).transform(df)


def _counted(df: DataFrame, cols: Sequence[str], bands: int | None) -> DataFrame:
    """``(feature, band, value, n)`` of every value that is not null."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    banded = add_bands(values, cut_points(values, cols, bands))
    return (
        banded.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("feature"), F.col(c + "_band").alias("band"), F.col(c).alias("value"))
                        for c in cols
                    ]
                )
            ).alias("r")
        )
        .select("r.*")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "band", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _starts(counts: DataFrame) -> DataFrame:
    """``(feature, band, n, start, total)``: one row per feature and band."""
    per_band = counts.groupBy("feature", "band").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy("feature").orderBy("band")
    return per_band.withColumn("start", F.sum("n").over(in_order) - F.col("n")).withColumn(
        "total", F.sum("n").over(Window.partitionBy("feature"))
    )


def exact_boundaries(df: DataFrame, cols: Sequence[str], buckets: int, bands: int | None = None) -> DataFrame:
    """``(feature, bounds)``: the distinct values at the ranks ``ceil(i * n / buckets)``, ascending.

    Ranks are exact, whatever the sketch said.  Nulls and NaN do not count; a
    column without any other value has no row.  Equal values share a bucket, so
    a frequent value makes fewer buckets, never a boundary twice.
    """
    if buckets < 2:
        raise ValueError("at least 2 buckets are needed")
    counts = _counted(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]), cols, bands)

    def rank(i):  # in whole numbers
        up = i * F.col("total") + (buckets - 1)
        return ((up - up % buckets) / buckets).cast("long")

    ranks = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), rank)
    held = F.filter(ranks, lambda r: (r > F.col("start")) & (r <= F.col("start") + F.col("n")))
    wanted = _starts(counts).withColumn("ranks", held).where(F.size("ranks") > 0).drop("n", "total")
    ends = F.col("start") + F.sum("n").over(Window.partitionBy("feature", "band").orderBy("value"))
    at = counts.join(F.broadcast(wanted), ["feature", "band"]).withColumn("end", ends)  # one row per feature and band
    hit = F.exists("ranks", lambda r: (r > F.col("end") - F.col("n")) & (r <= F.col("end")))
    return at.where(hit).groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("bounds"))  # < buckets


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float, bands: int | None = None) -> DataFrame:
    """``(feature, quantile)``: linear-interpolated exact quantile of each column.

    Values are counted per (feature, band, value) first; only the one or two
    bands that hold the wanted ranks are then put in order.
    """
    counts = _counted(df, cols, bands)
    per_band = _starts(counts)
    rank = F.lit(q) * (F.col("total") - 1)
    wanted = (
        per_band.withColumn("lo", F.floor(rank))
        .withColumn("hi", F.ceil(rank))
        .withColumn("part", rank - F.floor(rank))
        .where((F.col("start") <= F.col("hi")) & (F.col("start") + F.col("n") > F.col("lo")))
        .drop("n", "total")
    )
    inside = Window.partitionBy("feature", "band").orderBy("value")
    ranked = (
        counts.join(F.broadcast(wanted), ["feature", "band"])  # at most two rows per feature
        .withColumn("end", F.col("start") + F.sum("n").over(inside))
        .withColumn("begin", F.col("end") - F.col("n"))
    )

    def value_at(name):
        r = F.col(name)
        return F.max(F.when((F.col("begin") <= r) & (r < F.col("end")), F.col("value")))

    return (
        ranked.groupBy("feature")
        .agg(value_at("lo").alias("a"), value_at("hi").alias("b"), F.max("part").alias("part"))
        .select("feature", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))
    )
