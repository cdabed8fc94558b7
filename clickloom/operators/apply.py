"""Apply a whole fitted specification to a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.functions import dense as D
from clickloom.functions import vectors as V
from clickloom.operators.lookups import index_features
from clickloom.spec import CategoryField, DenseField, Field, TokensField, VectorField


def feature_column(f: Field) -> Column | None:
    """The feature as one Column, or None where a vocabulary join is needed."""
    if isinstance(f, DenseField):
        if f.transform is not None:
            return f.transform(F.col(f.name))
        if f.op == "bucketize":
            return D.bucketize(F.col(f.name), list(f.bounds))
        return D.by_name(f.op, F.col(f.name), f.p, f.q, f.generation) if f.op else F.col(f.name).cast("double")
    if isinstance(f, VectorField):
        return V.str_to_vec(F.col(f.name), f.dim, f.sep)
    if isinstance(f, CategoryField):
        if f.vocab and len(f.vocab) <= C.MAP_LITERAL_LIMIT:
            return C.index_literal(C.cleanup(f.before_vocab, F.col(f.name)), f.vocab)
        return None
    if isinstance(f, TokensField):
        if f.vocab and len(f.vocab) <= C.MAP_LITERAL_LIMIT:
            make = C.split_index_v2 if f.pad_first else C.split_pad_index
            return make(F.col(f.name), f.vocab, f.max_len, f.sep)
        return None
    raise ValueError(f"unknown feature kind {type(f).__name__}")


def apply_spec(
    df: DataFrame,
    fields: Sequence[Field],
    vocab: DataFrame | None = None,
    keep: Sequence[str] = (),
    key: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """``keep`` columns plus every feature under its own name.

    Short given vocabularies become literals; all other ones are looked up
    together, in one pass (``index_features``).  A shared vocabulary is looked up
    under the name in ``share``.  A null text of tokens counts as the empty text.
    ``key`` identifies a row where there is one; without it, a vocabulary of tokens
    too large for the tasks makes every row get a written number.  ``unique`` says
    that no value comes twice in a vocabulary, which else is checked for a large one.
    """
    columns = {f.name: feature_column(f) for f in fields}
    rest = [f for f in fields if columns[f.name] is None]
    sides, inputs = [] if vocab is None else [vocab.select("feature", F.col("value").cast("string").alias("value"), F.col("idx").cast("int").alias("idx"))], {}
    given = []
    for n, f in enumerate(rest):
        if f.vocab:
            feature = f"given {f.name}"
            given += [(feature, str(v), i) for i, v in enumerate(f.vocab, 1)]
        elif vocab is not None:
            feature = f.share or f.name
        else:
            raise ValueError(f"{f.name}: no vocabulary given or fitted")
        if isinstance(f, CategoryField):
            inputs[f"_out{n}"] = (feature, C.cleanup(f.before_vocab, F.col(f.name)).cast("string"))
            columns[f.name] = F.col(f"_out{n}")
        else:
            steps = C.tokens(F.coalesce(F.col(f.name), F.lit("")), f.sep, f.max_len)
            if f.pad_first:  # the empty text is looked up too, as in a short vocabulary
                steps = C.pad(steps, f.max_len, F.lit(""))
            inputs[f"_out{n}"] = (feature, steps)
            columns[f.name] = C.pad(F.col(f"_out{n}"), f.max_len, F.lit(0))
    if given:
        sides.append(df.sparkSession.createDataFrame(given, "feature string, value string, idx int"))
    out = index_features(df, key, inputs, reduce(DataFrame.union, sides), unique=unique) if inputs else df
    weights = {
        f.weight: C.split_pad_number(F.col(f.weight), f.max_len, f.sep)
        for f in fields
        if isinstance(f, TokensField) and f.weight
    }
    return out.select(*keep, *[c.alias(n) for n, c in {**columns, **weights}.items()])
