"""Fitting: vocabularies in one job, dense statistics in one aggregation."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.functions import dense as D
from clickloom.operators.bands import exact_boundaries
from clickloom.operators.ranking import global_rank, top_per_group
from clickloom.session import ship_package
from clickloom.spec import CategoryField, DenseField, Field, TokensField
from clickloom.storage import materialize


def _values(f: CategoryField | TokensField) -> Column:
    """All values one row contributes to the vocabulary of ``f``."""
    if isinstance(f, TokensField):
        return C.tokens(F.col(f.name), f.sep, f.max_len)
    return F.array(C.cleanup(f.before_vocab, F.col(f.name)).cast("string"))


def _drops_default(f: CategoryField | TokensField) -> bool:
    if f.min_cnt <= 1:
        return True
    return isinstance(f, CategoryField) and f.oov_equals_default


def value_counts(df: DataFrame, fields: Sequence[CategoryField | TokensField], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, value, count)`` of every field from a single pass.

    Rows are unpivoted in the map task and counted there first, so a hot value
    leaves each task as one row.
    """

    def pairs(f: CategoryField | TokensField) -> Column:
        made = F.transform(_values(f), lambda v: F.struct(F.lit(f.name).alias("feature"), v.alias("value")))
        return F.coalesce(made, F.array().cast("array<struct<feature:string,value:string>>"))

    return (
        df.select(*by, F.explode(F.concat(*[pairs(f) for f in fields])).alias("r"))
        .select(*by, "r.*")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "feature", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def kept_values(counts: DataFrame, fields: Sequence[CategoryField | TokensField]) -> DataFrame:
    """Frequency floor and default-value rule of each field."""
    keep = F.lit(False)
    for f in fields:
        rule = (F.col("feature") == f.name) & (F.col("count") >= f.min_cnt)
        if _drops_default(f):
            rule = rule & (F.col("value") != F.lit(str(f.default)))
        keep = keep | rule
    return counts.where(keep)


def fit_vocab(df: DataFrame, fields: Sequence[CategoryField | TokensField]) -> DataFrame:
    """``(feature, value, count, idx)``; 1..n by count descending, then value.

    The counted values are stored, so the table is passed once, and numbered by
    range partitioning: a vocabulary of any size is spread over all tasks.
    """
    return number_vocab(value_counts(df, fields), fields)


def number_vocab(counts: DataFrame, fields: Sequence[CategoryField | TokensField]) -> DataFrame:
    """The vocabulary of counted values ``(feature, value, count)``."""
    kept = materialize(kept_values(counts, fields), "counts")
    order = [F.col("count").desc(), F.col("value").asc()]
    ranked = global_rank(kept, order, by=["feature"], out="idx", unique=True)
    return materialize(ranked, "vocab")  # lookups then see a plain table of known size


def topk_vocab(df: DataFrame, fields: Sequence[CategoryField | TokensField], k: int) -> DataFrame:
    """The ``k`` most frequent values of every field."""
    kept = kept_values(value_counts(df, fields), fields)
    top = top_per_group(kept, ["feature"], [F.col("count").desc(), F.col("value").asc()], k, "idx")
    return top.withColumn("idx", F.col("idx").cast("long"))


def fit_dense_stats(df: DataFrame, defaults: Mapping[str, float], digits: int = 6) -> DataFrame:
    """One row per column: min, max, mean, stddev and the same two of ``ln(x)``.

    Values equal to the default count as missing; ``ln`` of a value <= 0 is
    NULL and stays out of the log statistics.
    """

    def stats(c: str, d: float) -> Column:
        x = F.when(F.col(c) == F.lit(d), None).otherwise(F.col(c)).cast("double")
        lx = F.ln(x)
        parts = {
            "min": F.min(x),
            "max": F.max(x),
            "mean": F.avg(x),
            "stddev": F.stddev_samp(x),
            "log_mean": F.avg(lx),
            "log_stddev": F.stddev_samp(lx),
        }
        return F.struct(
            F.lit(c).alias("feature"), *[F.round(e, digits).alias(n) for n, e in parts.items()]
        )

    one_row = df.agg(F.array(*[stats(c, d) for c, d in defaults.items()]).alias("a"))
    return one_row.select(F.explode("a").alias("r")).select("r.*")


# Which two statistics parametrize which transform.
PARAMETERS = {
    "normal": ("mean", "stddev"),
    "min_max": ("min", "max"),
    "log_normal": ("log_mean", "log_stddev"),
}


def ratio_param(size: int | Column):
    """Smoothing constant of ``ratio``: 1 for vectors longer than 5, else 2."""
    if isinstance(size, Column):
        return F.when(size > 5, F.lit(1.0)).otherwise(F.lit(2.0))
    return 1.0 if size > 5 else 2.0


def fit_all(df: DataFrame, fields: Sequence[Field]) -> tuple[DataFrame | None, DataFrame | None]:
    """Vocabulary table and statistics table for everything not given already."""
    open_vocab = [f for f in fields if isinstance(f, (CategoryField, TokensField)) and not f.vocab]
    open_dense = {f.name: f.default for f in fields if isinstance(f, DenseField) and f.op in PARAMETERS and f.p is None}
    return (
        fit_vocab(df, open_vocab) if open_vocab else None,
        fit_dense_stats(df, open_dense) if open_dense else None,
    )


def fit_boundaries(df: DataFrame, fields: Sequence[Field]) -> DataFrame | None:
    """``(feature, bounds)`` of every ``bucketize`` field without bounds: equal-mass buckets by exact rank.

    Values equal to the default count as missing, as in the other statistics.
    """
    wanted = [f for f in fields if isinstance(f, DenseField) and f.op == "bucketize" and not f.bounds]
    tables = []
    for k in sorted({f.buckets for f in wanted}):
        some = [f for f in wanted if f.buckets == k]
        known = [F.when(F.col(f.name) != F.lit(f.default), F.col(f.name)).alias(f.name) for f in some]
        tables.append(exact_boundaries(df.select(*known), [f.name for f in some], k))
    return reduce(DataFrame.union, tables) if tables else None


def _entropy_cuts(cells: pd.DataFrame, buckets: int) -> list[float]:
    """The cuts between cells that, one after the other, gain the most information on the label."""
    n, pos = (np.concatenate([[0], cells[c].to_numpy(dtype=float).cumsum()]) for c in ("n", "pos"))

    def loss(a, b):
        size, ones = n[b] - n[a], pos[b] - pos[a]
        out = np.zeros(np.shape(size))
        for part in (ones, size - ones):
            some = part > 0
            out[some] -= part[some] * np.log(part[some] / size[some])
        return out

    parts, cuts = [(0, len(cells))], []
    while len(cuts) < buckets - 1:
        found = []
        for a, b in parts:
            at = np.arange(a + 1, b)
            if len(at):
                gain = loss(np.full(1, a), np.full(1, b)) - loss(np.full(len(at), a), at) - loss(at, np.full(len(at), b))
                best = int(gain.argmax())
                found.append((gain[best], -at[best], a, b))
        gain, at, a, b = max(found, default=(0.0, 0, 0, 0))
        if not gain > 1e-9 * n[-1]:
            break
        parts.remove((a, b))
        parts += [(a, -at), (-at, b)]
        cuts.append(float(cells["low"].iloc[-at]))
    return sorted(cuts)


def fit_boundaries_by_label(df: DataFrame, cols: Sequence[str], label: str, buckets: int, cells: int = 256) -> DataFrame:
    """``(feature, bounds)``: cuts that tell most about a 0/1 label, chosen among ``cells`` equal-mass cells.

    The table is counted per feature and cell in one aggregation; the choice
    sees at most ``cells`` rows per feature.  Rows without a label or value do
    not count.  Fewer buckets come back where no further cut gains anything.
    """
    known = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *cols)
    bounds = {r["feature"]: r["bounds"] for r in exact_boundaries(known, cols, cells).collect()}  # < cells numbers a feature

    def cell(c: str) -> Column:
        edges = F.array(*[F.lit(b) for b in bounds[c]])
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        at = D.bucketize(x, bounds[c])
        low = F.when(at > 0, F.element_at(edges, F.greatest(at, F.lit(1)))).otherwise(F.lit(float("-inf")))
        return F.struct(F.lit(c).alias("feature"), F.when(x.isNotNull(), low).alias("low"))

    found = [cell(c) for c in cols if c in bounds]
    out = "feature string, bounds array<double>"
    if not found:
        return df.sparkSession.createDataFrame([], out)
    counted = (
        known.select("_y", F.explode(F.array(*found)).alias("r"))
        .select("_y", "r.*")
        .where(F.col("low").isNotNull())
        .groupBy("feature", "low")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    )

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("low")
        return pd.DataFrame({"feature": [rows["feature"].iloc[0]], "bounds": [_entropy_cuts(ordered, buckets)]})

    ship_package(df.sparkSession)
    return counted.groupBy("feature").applyInPandas(choose, out)


def with_boundaries(fields: Sequence[Field], bounds: DataFrame | None) -> list[Field]:
    """Specification with fitted bounds filled in (one short row per feature is read)."""
    fitted = {r["feature"]: tuple(r["bounds"]) for r in bounds.collect()} if bounds is not None else {}
    return [replace(f, bounds=fitted[f.name]) if isinstance(f, DenseField) and f.op == "bucketize" and not f.bounds and f.name in fitted else f for f in fields]


def with_parameters(fields: Sequence[Field], stats: DataFrame | None) -> list[Field]:
    """Specification with fitted numbers filled in (one short row per feature is read)."""
    fitted = {r["feature"]: r for r in stats.collect()} if stats is not None else {}
    out: list[Field] = []
    for f in fields:
        if isinstance(f, DenseField) and f.p is None:
            if f.op in PARAMETERS and f.name in fitted:
                p, q = PARAMETERS[f.op]
                f = replace(f, p=fitted[f.name][p], q=fitted[f.name][q])
            elif f.op == "ratio":
                f = replace(f, p=ratio_param(f.size))
        out.append(f)
    return out


def save_fitted(path: str, vocab: DataFrame, stats: DataFrame, bounds: DataFrame | None = None) -> None:
    """Vocabulary, statistics and, where there are any, bucket bounds as tables next to the dataset."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    if bounds is not None:
        bounds.write.mode("overwrite").parquet(f"{path}/bounds")


def load_fitted(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/stats")


def load_bounds(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/bounds")


def save_document(spark, path: str, document: dict) -> None:
    """A specification document (bounded by the number of features) as one JSON text."""
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)
