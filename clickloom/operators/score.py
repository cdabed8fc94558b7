"""Scoring expressed as joins and Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import vectors as V
from clickloom.operators.lookups import identified


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def predict(logit: Column, task: str = "binary") -> Column:
    if task not in ("binary", "regression"):
        raise ValueError("task must be binary or regression")
    return sigmoid(logit) if task == "binary" else logit


def score_linear(
    df: DataFrame,
    weights: DataFrame,
    sparse: Sequence[str] = (),
    dense: Mapping[str, float] = {},
    tokens: Sequence[str] = (),
    key: Sequence[str] = (),
    bias: float = 0.0,
    task: str = "binary",
) -> DataFrame:
    """Add ``logit`` and ``pred`` from an explicit ``(feature, idx, weight)`` table.

    ``sparse`` are index columns, ``tokens`` index arrays (padding 0 has no
    weight); ``key`` identifies a row and is needed for ``tokens`` only.  Rows
    that share it are kept apart.
    """
    logit: Column = F.lit(float(bias))
    names = df.columns
    if tokens:
        df, key = identified(df, key)
    out = df
    for f in sparse:
        side = weights.where(F.col("feature") == f).select(F.col("idx").alias("_i"), F.col("weight").alias(f"_w_{f}"))
        out = out.join(side, F.col(f) == F.col("_i"), "left").drop("_i")
        logit = logit + F.coalesce(F.col(f"_w_{f}"), F.lit(0.0))
    for f in tokens:
        side = weights.where((F.col("feature") == f) & (F.col("idx") != 0)).select(F.col("idx").alias("_i"), "weight")
        sums = (
            df.select(*key, F.explode(f).alias("_t"))
            .join(side, F.col("_t") == F.col("_i"))
            .groupBy(*key)
            .agg(F.sum("weight").alias(f"_w_{f}"))
        )
        out = out.join(sums, list(key), "left")
        logit = logit + F.coalesce(F.col(f"_w_{f}"), F.lit(0.0))
    for f, w in dense.items():
        logit = logit + F.col(f).cast("double") * F.lit(float(w))
    return out.withColumn("logit", logit).withColumn("pred", predict(F.col("logit"), task)).select(*names, "logit", "pred")


def esmm_compose(*stages) -> list[Column]:
    """Probability of reaching each stage: running products of the step probabilities."""
    out: list[Column] = []
    for s in stages:
        p = (F.col(s) if isinstance(s, str) else s).cast("double")
        out.append(p if not out else out[-1] * p)
    return out


def mix_experts(gate, experts: Sequence, normalize: bool = True) -> Column:
    """Softmax-gated sum of expert outputs (vectors)."""
    g = V.softmax(gate) if normalize else V.doubles(gate)
    dims = [V.doubles(e) for e in experts]

    def mixed(w: Column) -> Column:
        out = V.scale(dims[0], F.element_at(w, 1))
        for i, e in enumerate(dims[1:], 2):
            out = V.add(out, V.scale(e, F.element_at(w, i)))
        return out

    return V.let(g, mixed)


def piecewise_linear(region_logits, learner_logits) -> Column:
    """Softmax region scores times sigmoid learner scores, summed."""
    learner = F.transform(V.doubles(learner_logits), lambda x: 1 / (1 + F.exp(-x)))
    return V.dot(V.softmax(region_logits), learner)
