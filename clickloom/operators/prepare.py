"""Selection, casting, filling and checking of the training table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.spec import STORAGE_TYPES, DatasetSpec, spark_type


def select_spec(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The declared columns in declared order and storage type, nothing else."""
    return df.select(*[F.col(c.out).try_cast(STORAGE_TYPES[c.dtype]).alias(c.out) for c in spec.columns()])


def filter_scope(
    df: DataFrame, start: str, end: str, equal: Mapping[str, Any] = {}, member: Mapping[str, Sequence] = {}
) -> DataFrame:
    """``start <= dt <= end``, equalities and ``in`` lists; all reach the scan."""
    cond = F.col("dt").between(start, end)
    for c, v in equal.items():
        cond = cond & (F.col(c) == F.lit(v))
    for c, vs in member.items():
        cond = cond & F.col(c).isin(list(vs))
    return df.where(cond)


def cast_spec(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast by type name; a value that does not fit becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(spark_type(t)) for c, t in types.items()})


def fill_default(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Replace NULL by the declared default; maps are left alone."""
    kinds = {f.name: f.dataType for f in df.schema}
    filled = {}
    for c, d in defaults.items():
        if isinstance(d, dict):
            continue
        if isinstance(d, (list, tuple)):
            filled[c] = F.coalesce(F.col(c), F.array(*[F.lit(x) for x in d]).cast(kinds[c]))
        else:
            filled[c] = F.coalesce(F.col(c), F.lit(d).cast(kinds[c]))
    return df.withColumns(filled)


def label_threshold(df: DataFrame, col: str, at_least: float, out: str) -> DataFrame:
    return df.withColumn(out, (F.col(col) >= F.lit(at_least)).cast("float"))


def split_labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One struct of features and one label: a plain column, or a struct of several."""
    check = [c for c in labels if c not in df.columns]
    if check:
        raise KeyError(f"labels not in the table: {check}")
    features = F.struct(*[c for c in df.columns if c not in labels]).alias("features")
    label = F.col(labels[0]).alias("label") if len(labels) == 1 else F.struct(*labels).alias("label")
    return df.select(features, label)


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested structs to flat ``outer_inner`` columns."""

    def walk(fields, path, name) -> list[Column]:
        out: list[Column] = []
        for f in fields:
            p, n = [*path, f.name], f"{name}_{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType.fields, p, n)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in p)).alias(n))
        return out

    return df.select(*walk(df.schema.fields, [], ""))


def flatten_array(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Nested arrays to one flat array."""
    c, kind = F.col(col), df.schema[col].dataType
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    return df.withColumn(out or col, c)


def validate_data(df: DataFrame, types: Mapping[str, str], defaults: Mapping[str, Any]) -> DataFrame:
    """Per column: rows, NULLs, values that do not fit the type, default values.

    One aggregation for all columns, unpivoted to one row per column.
    """
    sums = []
    for c, t in types.items():
        cast = F.col(c).try_cast(spark_type(t))
        bad = F.col(c).isNotNull() & cast.isNull()
        d = defaults.get(c)
        is_default = F.lit(False) if d is None or isinstance(d, (dict, list, tuple)) else cast == F.lit(d)
        sums.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(F.col(c).isNull()).alias("n_null"),
                F.count_if(bad).alias("n_bad"),
                F.count_if(F.coalesce(is_default, F.lit(False))).alias("n_default"),
            )
        )
    return df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def build_training_table(
    df: DataFrame,
    types: Mapping[str, str],
    defaults: Mapping[str, Any],
    hook: Callable[[DataFrame], DataFrame] | None = None,
    profile: DataFrame | None = None,
    keys: Sequence[str] = ("dt", "user_id"),
) -> DataFrame:
    """Join, cast, fill and a user hook: the same steps for training and validation days."""
    if profile is not None:
        df = df.join(profile, list(keys), "left")
    df = fill_default(cast_spec(df, types), defaults)
    return df.transform(hook) if hook else df
