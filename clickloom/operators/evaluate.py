"""Exact ranking metrics and losses.

AUC is the tie-corrected rank statistic: pairs (positive, lower-scored negative)
count 1, tied pairs 1/2.  Scores are counted per distinct value first and summed
in equal-mass score bands, so no task ever holds a whole table or a whole hot
user.  One-class groups have no AUC and give NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.operators.bands import add_bands, cut_points


def _levels(df: DataFrame, label: str, score: str, by: Sequence[str], bands: int | None) -> DataFrame:
    """Positives and negatives per (by..., band, distinct score)."""
    rows = df.select(
        *by, F.col(label).cast("double").cast("long").alias("_y"), F.col(score).cast("double").alias("_s")
    ).where(F.col("_y").isNotNull() & F.col("_s").isNotNull())
    return (
        add_bands(rows, cut_points(rows, ["_s"], bands))
        .groupBy(*by, "_s_band", "_s")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    )


def _auc(levels: DataFrame, by: Sequence[str]) -> DataFrame:
    lower = Window.partitionBy(*by, "_s_band").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    area = F.col("pos") * (F.coalesce(F.sum("neg").over(lower), F.lit(0)) + F.col("neg") / 2)
    per_band = (
        levels.withColumn("area", area)
        .groupBy(*by, "_s_band")
        .agg(F.sum("area").alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # one row per group and band here
    below = Window.partitionBy(*by).orderBy("_s_band").rowsBetween(Window.unboundedPreceding, -1)
    total = per_band.withColumn(
        "area", F.col("area") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0))
    )
    sums = [F.sum("area").alias("area"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    return total.groupBy(*by).agg(*sums).select(
        *by,
        F.try_divide(F.col("area"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
        (F.col("n_pos") + F.col("n_neg")).alias("n_rows"),
        "n_pos",
        "n_neg",
    )


def _mean_of_groups(per_group: DataFrame, by: Sequence[str], digits: int) -> DataFrame:
    weight = F.when(F.col("auc").isNotNull(), F.col("n_rows"))
    return per_group.groupBy(*by).agg(
        F.round(F.try_divide(F.sum(F.col("auc") * weight), F.sum(weight)), digits).alias("gauc"),
        F.count("auc").alias("n_groups"),
    )


def auc_table(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), bands: int | None = None
) -> DataFrame:
    """``(by..., auc, n_rows, n_pos, n_neg)``."""
    return _auc(_levels(df, label, score, by, bands), by)


def auc_global(df: DataFrame, label: str, score: str, digits: int = 5, bands: int | None = None) -> DataFrame:
    return auc_table(df, label, score, (), bands).select(F.round("auc", digits).alias("auc"), "n_rows")


def gauc(
    df: DataFrame,
    label: str,
    score: str,
    group: str,
    digits: int = 5,
    by: Sequence[str] = (),
    bands: int | None = None,
) -> DataFrame:
    """Row-weighted mean of per-group AUC over groups that have both classes."""
    return _mean_of_groups(auc_table(df, label, score, [*by, group], bands), by, digits)


def ranking_report(
    df: DataFrame, label: str, score: str, group: str, by: Sequence[str], digits: int = 5, bands: int | None = None
) -> DataFrame:
    """``(by..., auc, n_rows, gauc, n_groups)`` from one count of the scores.

    The counts per (by, group, score) serve the grouped metric directly and,
    summed over the groups, the whole one.
    """
    levels = _levels(df, label, score, [*by, group], bands)
    merged = levels.groupBy(*by, "_s_band", "_s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = _auc(merged, by).select(*by, F.round("auc", digits).alias("auc"), "n_rows")
    return _join_same(whole, _mean_of_groups(_auc(levels, [*by, group]), by, digits), by)


def _join_same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with equal ``by`` side by side; a null equals a null."""
    named = right.select(*(F.col(c).alias(f"_same_{c}") for c in by), *(c for c in right.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return left.join(named, same).drop(*(f"_same_{c}" for c in by))


def unpivot_labels(df: DataFrame, labels: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, task): ``labels`` maps a label column to its score column."""
    return df.select(
        *keep,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(y).alias("task"),
                        F.col(y).cast("double").alias("label"),
                        F.col(s).cast("double").alias("score"),
                    )
                    for y, s in labels.items()
                ]
            )
        ).alias("_t"),
    ).select(*keep, "_t.*")


def auc_by_label(df: DataFrame, labels: Mapping[str, str], group: str, digits: int = 5) -> DataFrame:
    """AUC and grouped AUC of every task."""
    long = unpivot_labels(df, labels, [group])
    return ranking_report(long, "label", "score", group, ["task"], digits).select("task", "auc", "gauc")


def auc_binned(df: DataFrame, label: str, score: str, thresholds: int = 200, digits: int = 6) -> DataFrame:
    """AUC of the threshold curve used while training.

    Thresholds are ``i / (n - 1)``, the outer two moved just outside [0, 1]; a
    score counts as positive above a threshold; the curve is closed by the
    trapezoid rule.  The table shrinks to one row per threshold interval in the
    first aggregation.
    """
    n = thresholds - 1
    s = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    # number of inner thresholds i/n (1 <= i < n) strictly below the score
    step = F.least(F.greatest(F.ceil(s * n) - 1, F.lit(0)), F.lit(n - 1))
    y = F.col(label).cast("long")
    cells = (
        df.where(y.isNotNull() & F.col(score).isNotNull())
        .groupBy(step.alias("cell"))
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )
    up = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)  # <= `thresholds` rows
    curve = cells.withColumn("tp", F.sum("pos").over(up)).withColumn("fp", F.sum("neg").over(up))
    area = (F.col("tp") + F.col("tp") - F.col("pos")) / 2 * F.col("neg")
    return curve.agg(
        F.round(F.try_divide(F.sum(area), F.sum("pos").cast("double") * F.sum("neg")), digits).alias("auc")
    )


def logloss_term(label, pred, eps: float = 1e-7) -> Column:
    y = F.col(label).cast("double")
    p = F.least(F.greatest(F.col(pred).cast("double"), F.lit(eps)), F.lit(1 - eps))
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def weighted_mean(x: Column, weight: str | None) -> Column:
    if weight is None:
        return F.avg(x)
    w = F.when(x.isNotNull(), F.col(weight))
    return F.try_divide(F.sum(x * w), F.sum(w))


def losses(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), weight: str | None = None, digits: int = 6) -> DataFrame:
    """Log loss, squared and absolute error, and the two means, in one aggregation."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    parts = {
        "logloss": logloss_term(label, pred),
        "mse": (y - p) * (y - p),
        "mae": F.abs(y - p),
        "label_mean": y,
        "pred_mean": p,
    }
    return df.groupBy(*by).agg(
        *[F.round(weighted_mean(e, weight), digits).alias(n) for n, e in parts.items()],
        F.count(F.lit(1)).alias("n_rows"),
    )


def aligned_predictions(scored: DataFrame, labels: Sequence[str], pred: str, user: str = "user_id") -> DataFrame:
    """Label, user and prediction columns of one scored table, row by row."""
    return scored.select(user, *labels, pred)


def compare_models(scored: DataFrame, label: str, score: str, version: str, group: str) -> DataFrame:
    """The metrics of every model version on the same rows."""
    ranking = ranking_report(scored, label, score, group, [version]).select(version, "auc", "gauc")
    return _join_same(ranking, losses(scored, label, score, [version]).select(version, "logloss", "n_rows"), [version])


def calibration(df: DataFrame, label: str, pred: str, deciles: int = 10) -> DataFrame:
    """Mean prediction against mean label in equal-width score buckets."""
    p = F.col(pred).cast("double")
    bucket = F.least(F.floor(p * deciles), F.lit(deciles - 1)).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(p), 6).alias("mean_pred"),
        F.round(F.avg(F.col(label).cast("double")), 6).alias("mean_label"),
    )


def _monotone(cells: Column) -> Column:
    """Least-squares rising fit of ``cells`` (n_rows, n_pos in order): the greatest over starts of the least mean over ends.

    The same numbers as by pooling adjacent violators, without their order of merging.
    """

    def mean(i, j):
        part = F.slice(cells, i, j - i + 1)
        total = lambda name: F.aggregate(part, F.lit(0).cast("long"), lambda a, c: a + c[name])
        return total("n_pos").cast("double") / total("n_rows")

    size = F.size(cells)
    return F.transform(
        F.sequence(F.lit(1), size),
        lambda k: F.array_max(
            F.transform(
                F.sequence(F.lit(1), k),
                lambda i: F.array_min(F.transform(F.sequence(k, size), lambda j: mean(i, j))),
            )
        ),
    )


def calibration_deciles(
    df: DataFrame, label: str, pred: str, cells: int = 10, by: Sequence[str] = (), bands: int | None = None
) -> DataFrame:
    """``(by..., cell, n_rows, mean_pred, mean_label, monotone)`` in cells of equal mass by score rank.

    A row's cell is ``floor(cells * rows with a lower score / all rows)``: equal
    scores stay together, so a frequent score can leave cells empty (no row).
    ``monotone`` is the rising fit of the labels over the cells, which corrects
    a score without changing the order.
    """
    levels = _levels(df, label, pred, by, bands).withColumn("n", F.col("pos") + F.col("neg"))
    per_band = levels.groupBy(*by, "_s_band").agg(F.sum("n").alias("_n"))
    groups = Window.partitionBy(*by)  # one row per group and band
    starts = per_band.select(
        *by,
        "_s_band",
        (F.sum("_n").over(groups.orderBy("_s_band")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(groups).alias("_total"),
    )
    inside = Window.partitionBy(*by, "_s_band").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    placed = _join_same(levels.withColumn("_below", F.coalesce(F.sum("n").over(inside), F.lit(0))), starts, [*by, "_s_band"])
    cell = F.floor((F.col("_start") + F.col("_below")) * cells / F.col("_total")).cast("int")
    sums = placed.groupBy(*by, cell.alias("cell")).agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"), F.sum(F.col("_s") * F.col("n")).alias("s")
    )
    rows = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cell", "n_rows", "n_pos", "s"))).alias("c"))  # `cells` at most
    rows = rows.where(F.size("c") > 0)
    return rows.select(*by, F.explode(F.arrays_zip("c", _monotone(F.col("c")).alias("m"))).alias("r")).select(
        *by,
        F.col("r.c.cell").alias("cell"),
        F.col("r.c.n_rows").alias("n_rows"),
        F.round(F.col("r.c.s") / F.col("r.c.n_rows"), 6).alias("mean_pred"),
        F.round(F.col("r.c.n_pos") / F.col("r.c.n_rows"), 6).alias("mean_label"),
        F.round("r.m", 6).alias("monotone"),
    )
