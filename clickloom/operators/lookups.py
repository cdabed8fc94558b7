"""Equi-join lookups: profiles, vocabularies and embedding tables.

No broadcast hints here.  The lookup sides can be of any size; Spark broadcasts
them when their measured size is below its threshold and otherwise shuffles,
with adaptive execution splitting the partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.operators.prepare import cast_spec, fill_default
from clickloom.session import ship_package
from clickloom.spec import ProfileField
from clickloom.storage import materialize


def join_profiles(
    df: DataFrame, fields: Sequence[ProfileField], profiles: Mapping[int, DataFrame], roles: Mapping[str, str]
) -> DataFrame:
    """Attach profile values by role.

    ``profiles``: profile number -> table with a ``key`` column.  ``roles``: key
    type -> row column that holds the key.  One join per (profile, role), however
    many values it brings; ``ctx`` values are on the row already.
    """
    wanted: dict[tuple[int, str], list[ProfileField]] = {}
    on_row: dict[str, Column] = {}
    for f in fields:
        if f.source is None:
            continue
        if f.source.key_type == "ctx":
            on_row[f.name] = F.col(f.source.column)
        else:
            wanted.setdefault((f.source.pid, f.source.key_type), []).append(f)
    out = df.withColumns(on_row) if on_row else df
    for (pid, role), group in wanted.items():
        key = f"_key_{pid}_{role}"
        side = profiles[pid].select(
            F.col("key").alias(key), *[F.col(f.source.column).alias(f.name) for f in group]
        )
        out = out.join(side, F.col(roles[role]) == F.col(key), "left").drop(key)
    sourced = [f for f in fields if f.source is not None]
    out = cast_spec(out, {f.name: f.datatype for f in sourced})
    return fill_default(out, {f.name: f.default for f in sourced})


def index_by_vocab(
    df: DataFrame, col: str, vocab: DataFrame, out: str, cleanup: str | None = None, missing: int = 0
) -> DataFrame:
    """value -> index through a ``(value, idx)`` table; unknown -> ``missing``."""
    side = vocab.select(F.col("value").cast("string").alias("_v"), F.col("idx").cast("int").alias("_idx"))
    joined = df.join(side, C.cleanup(cleanup, F.col(col)).cast("string") == F.col("_v"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_idx"), F.lit(missing))).drop("_v", "_idx")


def identified(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table with columns that identify a row: ``key`` where it does, else a written number."""
    missing = " OR ".join(f"`{c}` IS NULL" for c in key)
    if key and df.groupBy(*key).count().where(f"count > 1 OR {missing}").isEmpty():
        return df, list(key)
    return materialize(df.withColumn("_number", F.monotonically_increasing_id()), "numbered"), ["_number"]


def index_tokens_by_vocab(
    df: DataFrame, key: Sequence[str], tokens: Column, vocab: DataFrame, out: str, max_len: int, pad: bool = True
) -> DataFrame:
    """Index every token of a cut token array through a vocabulary table.

    ``key`` names the row; rows that share it are kept apart.  Tokens travel alone, at most ``max_len`` per row.
    """
    df, key = identified(df, key)
    side = vocab.select(F.col("value").alias("_v"), F.col("idx").cast("int").alias("_idx"))
    steps = (
        df.select(*key, F.posexplode(F.slice(tokens, 1, max_len)).alias("_pos", "_tok"))
        .join(side, F.col("_tok") == F.col("_v"), "left")
        .groupBy(*key)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_idx", F.lit(0)).alias("i")))),
                lambda s: s["i"],
            ).alias("_ids")
        )
    )
    ids = F.coalesce(F.col("_ids"), F.array().cast("array<int>"))
    padded = C.pad(ids, max_len, F.lit(0)) if pad else ids
    return df.join(steps, key, "left").withColumn(out, padded).drop("_ids", "_number")


#: A vocabulary of at most this many bytes (value texts and 16 a row) is sent to every task; a larger one is joined.
VOCABULARY_BYTES = 32 << 20


def index_features(
    df: DataFrame, key: Sequence[str], inputs: Mapping[str, tuple[str, Column]], vocab: DataFrame, limit: int = VOCABULARY_BYTES, *, unique: bool = False
) -> DataFrame:
    """Index any number of features against one vocabulary table.

    ``inputs``: name of the new column -> (feature whose vocabulary it reads, text
    or array of texts); ``vocab`` is ``(feature, value, idx)``, ``unique`` says that
    no value comes twice in a feature.  A text becomes its index, an array that of
    each element; 0 stands for what is null or unknown, and a null array counts as
    empty.

    Vocabularies that together fit ``limit``, the smallest first, go to the tasks,
    and no row moves.  A larger one is joined: rows with their text, arrays by one
    row (feature, value) for every element, one join and one grouping and join that
    bring the indices back; ``key`` identifies a row there (a stored number, where
    it does not).  Adaptive execution splits the partitions of frequent values.
    """
    if not inputs:
        return df
    wanted = sorted({f for f, _ in inputs.values()})
    side = vocab.where(F.col("feature").isin(wanted)).select("feature", F.col("value").cast("string").alias("value"), F.col("idx").cast("int").alias("idx"))
    sizes = {r.feature: r.n for r in side.groupBy("feature").agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 16).alias("n")).collect()}
    types = dict(df.select(*[c.alias(name) for name, (_, c) in inputs.items()]).dtypes)
    arrays = {name: types[name].startswith("array") for name in inputs}
    sent, room = [], limit
    for n, feature in sorted((sizes.get(f, 0), f) for f in wanted):
        if n <= room:
            sent.append(feature)
            room -= n
    joined = {f"_far{n}": x for n, (name, x) in enumerate(inputs.items()) if x[0] not in sent}
    far = {f"_far{n}": name for n, name in enumerate(inputs) if f"_far{n}" in joined}
    columns = [f"`{c}`" for c in dict.fromkeys([*df.columns, *inputs])]
    if joined:
        mine = side.where(F.col("feature").isin([f for f, _ in joined.values()]))
        df = _index_by_join(df, key, joined, mine, {x: arrays[name] for x, name in far.items()}, unique)
    near = {name: x for name, x in inputs.items() if x[0] in sent}
    if near:
        df = _index_in_tasks(df, near, side.where(F.col("feature").isin(sent)), arrays)
    return df.withColumns({name: F.col(x) for x, name in far.items()}).select(*columns) if joined else df


def _index_in_tasks(df: DataFrame, inputs, side: DataFrame, arrays: Mapping[str, bool]) -> DataFrame:
    ship_package(df.sparkSession)
    known: dict[str, tuple[list[str], list[int]]] = {}
    for r in side.collect():  # measured before
        values, places = known.setdefault(r.feature, ([], []))
        values.append(r.value)
        places.append(r.idx)
    shared = df.sparkSession.sparkContext.broadcast(known)
    made = [(f"_x{n}", name, feature) for n, (name, (feature, _)) in enumerate(inputs.items())]

    def found(feature: str, texts: pa.Array) -> np.ndarray:
        values, places = shared.value.get(feature, ([], []))
        at = pc.index_in(texts, pa.array(values, texts.type), skip_nulls=True)
        return np.append(np.array(places, np.int32), np.int32(0))[at.fill_null(len(places)).to_numpy(zero_copy_only=False)]

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for (_, name, feature), c in zip(made, columns):
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            if arrays[name]:
                ends = np.concatenate([[0], np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(found(feature, c.flatten()))))
            else:
                out.append(pa.array(found(feature, c)))
        return pa.StructArray.from_arrays(out, names=[x for x, *_ in made])

    kind = ", ".join(f"{x} {'array<int>' if arrays[name] else 'int'}" for x, name, _ in made)
    texts = [c.cast("array<string>" if arrays[name] else "string") for name, (_, c) in inputs.items()]
    out = df.withColumn("_indexed", F.arrow_udf(run, kind)(*texts))
    return out.withColumns({name: F.col(f"_indexed.{x}") for x, name, _ in made}).drop("_indexed")


def _index_by_join(df: DataFrame, key: Sequence[str], inputs, side: DataFrame, arrays: Mapping[str, bool], unique: bool) -> DataFrame:
    single = {name: x for name, x in inputs.items() if not arrays[name]}
    lists = {name: x for name, x in inputs.items() if arrays[name]}
    if lists:
        df = _index_arrays_by_join(df, key, lists, side)
    if single and not unique and not side.groupBy("feature", "value").count().where("count > 1").isEmpty():
        side = materialize(side.groupBy("feature", "value").agg(F.max("idx").alias("idx")), "values")
    for name, (feature, c) in single.items():  # the texts of all, before the first join: they may read what a later name stands for
        df = df.withColumn(f"_text{name}", c.cast("string"))
    for name, (feature, _) in single.items():
        mine = side.where(F.col("feature") == feature).select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
        df = df.join(mine, F.col(f"_text{name}") == F.col("_v"), "left").withColumn(name, F.coalesce("_i", F.lit(0))).drop("_v", "_i", f"_text{name}")
    return df


def _index_arrays_by_join(df: DataFrame, key: Sequence[str], inputs, side: DataFrame) -> DataFrame:
    df, key = identified(df, key)

    def values(n: int, feature: str, texts: Column) -> Column:
        texts = F.coalesce(texts, F.array().cast("array<string>"))
        return F.transform(texts, lambda t, i: F.struct(F.lit(n).alias("no"), i.alias("pos"), F.lit(feature).alias("feature"), t.alias("value")))

    each = [values(n, feature, c.cast("array<string>")) for n, (_, (feature, c)) in enumerate(inputs.items())]
    rows = df.select(*key, F.explode(F.concat(*each)).alias("_e")).select(*key, "_e.*")
    rows = rows.join(side, ["feature", "value"], "left").withColumn("idx", F.coalesce("idx", F.lit(0)))
    made = []
    for n in range(len(inputs)):
        steps = F.array_sort(F.collect_list(F.when(F.col("no") == n, F.struct("pos", "idx"))))
        made.append(F.transform(steps, lambda s: s["idx"]).alias(f"_x{n}"))
    back = rows.groupBy(*key).agg(*made)
    columns = {name: F.coalesce(f"_x{n}", F.array().cast("array<int>")) for n, name in enumerate(inputs)}
    return df.join(back, key, "left").withColumns(columns).drop("_number", *[f"_x{n}" for n in range(len(inputs))])


def embedding_lookup(
    df: DataFrame, idx: str, table: DataFrame, out: str, default: Sequence[float] | None = None
) -> DataFrame:
    """index -> vector from an ``(idx, vec)`` table; several columns may share one table."""
    side = table.select(F.col("idx").alias("_i"), F.col("vec").alias("_vec"))
    joined = df.join(side, F.col(idx) == F.col("_i"), "left")
    vec = F.col("_vec") if default is None else F.coalesce("_vec", F.array(*[F.lit(float(x)) for x in default]))
    return joined.withColumn(out, vec).drop("_i", "_vec")


def varlen_embedding_lookup(df: DataFrame, key: Sequence[str], ids: str, table: DataFrame, out: str) -> DataFrame:
    """array of indices -> array of vectors, position by position.

    A step without a vector gets zeros, so that vectors and mask stay aligned.
    The arrays are bounded by the maximum sequence length of the feature, so a
    re-collected group is bounded too.
    """
    df, key = identified(df, key)
    side = table.select(F.col("idx").alias("_i"), F.col("vec").alias("_vec"))
    width = side.agg(F.max(F.size("_vec"))).first()[0] or 0
    kind = side.schema["_vec"].dataType
    zeros = F.array_repeat(F.lit(0.0), width).cast(kind)
    steps = (
        df.select(*key, F.posexplode(ids).alias("_pos", "_id"))
        .join(side, F.col("_id") == F.col("_i"), "left")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_vec", zeros).alias("_vec")))).alias("_steps"))
    )
    return (
        df.join(steps, key, "left")
        .withColumn(out, F.transform("_steps", lambda s: s["_vec"]))
        .drop("_steps", "_number")
    )


def mean_vector(table: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: element-wise mean of all vectors (a small, map-side combined aggregate)."""
    return (
        table.select(F.posexplode(vec).alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    )


def pretrained_matrix(vocab: DataFrame, table: DataFrame) -> DataFrame:
    """Vectors in the order default + vocabulary: ``(idx, value, vec)``.

    ``table`` is ``(word, vec, row)``; its row 0 is replaced by the mean of all
    vectors (row 0 included), and words that are not in the table get row 0.
    Row 0 of the result is that default.
    """
    default = mean_vector(table)
    side = table.select(F.col("word").alias("_w"), F.when(F.col("row") != 0, F.col("vec")).alias("_vec"))
    words = vocab.select(F.col("value"), F.col("idx").cast("long").alias("idx")).join(
        side, F.col("value") == F.col("_w"), "left"
    )
    first = default.select(
        F.lit(0).cast("long").alias("idx"), F.lit(None).cast("string").alias("value"), F.col("mean").alias("vec")
    )
    rest = words.select(
        "idx", "value", F.coalesce(F.col("_vec").cast("array<double>"), default.scalar()).alias("vec")
    )
    return first.unionByName(rest)


def emb_value_lookup(df: DataFrame, col: str, table: DataFrame, out: str, default_key: str = "-1") -> DataFrame:
    """id -> stored vector; unknown ids take the vector stored under ``default_key``."""
    default = table.where(F.col("key") == default_key).agg(F.first("vec")).scalar()
    side = table.select(F.col("key").alias("_k"), F.col("vec").alias("_vec"))
    return (
        df.join(side, F.col(col).cast("string") == F.col("_k"), "left")
        .withColumn(out, F.coalesce("_vec", default))
        .drop("_k", "_vec")
    )

