"""Exact row numbers without a window that holds a whole table or hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.storage import materialize


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    out: str = "rn",
    partitions: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add ``out`` = 1-based position inside each ``by`` group along ``order``.

    The table is range-partitioned by ``(by, order)``, so a group of any size
    is cut into sorted, equally filled runs.  One number per (group, run) is
    then enough to turn positions inside a run into positions in the group.

    Rows that tie in ``order`` (copies of one row, say) could not be cut apart
    by range.  They first get a stored number each, as the last sort key; pass
    ``unique=True`` where ``order`` has no ties inside a group to save that step.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(c).asc() for c in by] + list(order)
    numbered = df
    if not unique:
        # stored, so that a lost task cannot number its rows differently
        numbered = materialize(df.withColumn("_tie", F.monotonically_increasing_id()), "numbered")
        sort_cols.append(F.col("_tie").asc())
    runs = materialize(
        numbered.repartitionByRange(partitions, *sort_cols)
        .sortWithinPartitions(*sort_cols)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_run", F.shiftright("_row", 33))

    heads = runs.groupBy(*by, "_run").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # at most one row per run and group: the window below sees run counts only
    earlier = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    shifts = heads.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_run").alias("_by_run"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    on = F.col("_run") == F.col("_by_run")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    if not by:
        shifts = F.broadcast(shifts)  # one row per run, never more than `partitions`
    return runs.join(shifts, on).select(
        *df.columns, (F.col("_row") + F.col("_shift")).cast("long").alias(out)
    )


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows of every group.

    The ``row_number() <= k`` shape lets Spark keep only k rows per group in
    each map task, so a hot group never travels whole.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
