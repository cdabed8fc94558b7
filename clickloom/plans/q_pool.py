"""Sequence pooling: 8 steps of 8 numbers per stored embedding, the first ``label`` of them valid."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.functions import pooling as P
from clickloom.plans.q_joins import WORD_VOCAB, word_rows
from clickloom.plans.registry import query
from clickloom.plans.views import field_vectors, field_vectors_sql, fixed
from clickloom.spec import TokensField

FIELDS = [f"f{i}" for i in range(8)]
CELLS = f"""{field_vectors_sql()},
  steps AS (SELECT vec_id, label, f7 AS q, unnest([{', '.join(FIELDS)}]) AS v, unnest([1,2,3,4,5,6,7,8]) AS pos FROM fields),
  m AS (SELECT *, CAST(pos <= label AS INT) AS mask, least(label, 8) AS n FROM steps),
  cells AS (SELECT vec_id, label, n, pos, mask, v[1] AS w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM m)"""


def by_dim(value: str, source: str = "cells") -> str:
    return f"""SELECT vec_id, array_to_string(list(CAST(round(z * 1e6) AS BIGINT) ORDER BY i), ',') AS pooled
    FROM (SELECT vec_id, i, {value} AS z FROM {source} GROUP BY vec_id, i, label, n) GROUP BY vec_id"""


def _rows(spark, sf):
    return (
        field_vectors(spark, sf)
        .withColumn("seq", F.array(*FIELDS))
        .withColumn("mask", C.length_mask("label", 8))
        .withColumn("w", F.transform("seq", lambda v: F.get(v, F.lit(0))))
    )


def _pool(name, sql, make):
    @query(name, sql)
    def run(spark, sf):
        return _rows(spark, sf).select("vec_id", fixed(make()).alias("pooled"))


_pool("pool_sum", f"WITH {CELLS} {by_dim('sum(x * mask)')}", lambda: P.pool_sum("seq", "mask", 8))
_pool(
    "pool_mean",
    f"WITH {CELLS} {by_dim('sum(x * mask) / (n + 1e-6::DOUBLE)')}",
    lambda: P.pool_mean("seq", "mask", 8, P.EPS_V2),
)
_pool("pool_max", f"WITH {CELLS} {by_dim('max(x - (1 - mask) * 1e9::DOUBLE)')}", lambda: P.pool_max("seq", "mask", 8))

SOFT = """soft AS (SELECT *, exp(s - max(s) OVER w) / sum(exp(s - t)) OVER w AS a FROM
  (SELECT *, max(s) OVER (PARTITION BY vec_id) AS t FROM scored) WINDOW w AS (PARTITION BY vec_id)),
  att AS (SELECT vec_id, label, n, a, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM soft)"""
_pool(
    "pool_weighted",
    f"""WITH {CELLS}, scored AS (SELECT *, CASE WHEN mask = 1 THEN v[1] ELSE -4294967295 END AS s FROM m), {SOFT}
    {by_dim('sum(x * a)', 'att')}""",
    lambda: P.pool_weighted("seq", "w", "mask", 8),
)
_pool(
    "pool_attention_dot",
    f"""WITH {CELLS}, scored AS (SELECT *, CASE WHEN mask = 1 THEN list_dot_product(v, q) / sqrt(8) ELSE 1e-12 END AS s FROM m), {SOFT}
    {by_dim('sum(x * a)', 'att')}""",
    lambda: P.pool_attention_dot("seq", "f7", "mask", 8),
)


@query("pool_weighted_average", f"WITH {CELLS} {by_dim('sum(x * pos * mask) / (sum(pos * mask) + 1e-6::DOUBLE)')}")
def pool_weighted_average(spark, sf):
    """Weights come from a parallel comma-joined text: '1,2,3' for three valid steps."""
    text = F.when(F.col("label") == 0, "").otherwise(
        F.array_join(F.sequence(F.lit(1), F.greatest("label", F.lit(1))).cast("array<string>"), ",")
    )
    rows = _rows(spark, sf).withColumn("weight", C.split_pad_number(text, 8))
    return rows.select("vec_id", fixed(P.pool_weighted_average("seq", "weight", 8)).alias("pooled"))


@query(
    "pool_group_concat",
    f"""WITH {CELLS}, a AS ({by_dim('sum(x * mask)')}), b AS ({by_dim('sum(x * mask) / (n + 1e-6::DOUBLE)')}),
    c AS ({by_dim('max(x - (1 - mask) * 1e9::DOUBLE)')})
    SELECT vec_id, a.pooled || ',' || b.pooled || ',' || c.pooled AS pooled FROM a JOIN b USING (vec_id) JOIN c USING (vec_id)""",
)
def pool_group_concat(spark, sf):
    return _rows(spark, sf).select("vec_id", fixed(P.pool_concat(["sum", "mean", "max"], "seq", "mask", 8)).alias("pooled"))


WORD_CELLS = f"{WORD_VOCAB}, wc AS (SELECT p_partkey, pos, unnest(CAST(vec AS DOUBLE[])) AS x, generate_subscripts(vec, 1) AS i FROM steps)"


def word_pool(value: str) -> str:
    return f"""SELECT p_partkey, array_to_string(list(CAST(round(z * 1e6) AS BIGINT) ORDER BY i), ',') AS p
    FROM (SELECT p_partkey, i, {value} AS z FROM wc GROUP BY p_partkey, i) GROUP BY p_partkey"""


@query(
    "pool_spec",
    f"""WITH {WORD_CELLS}, a AS ({word_pool('sum(x) / (count(*) + 1e-6::DOUBLE)')}), b AS ({word_pool('sum(x)')}), c AS ({word_pool('max(x)')})
    SELECT p_partkey, a.p || ';' || b.p AS words_group, c.p AS best_group FROM a JOIN b USING (p_partkey) JOIN c USING (p_partkey)""",
)
def pool_spec(spark, sf):
    """Three features over the same looked-up words: mean and sum in one group, max in another."""
    rows = word_rows(spark, sf).withColumn("mask", C.seq_mask("word_ids"))
    fields = [
        TokensField("m", pooling="mean", group="words_group"),
        TokensField("s", pooling="sum", group="words_group"),
        TokensField("x", pooling="max", group="best_group"),
    ]
    names = [f.name for f in fields]
    groups = P.pool_by_group(fields, dict.fromkeys(names, "word_vecs"), dict.fromkeys(names, "mask"), 64)
    return rows.select("p_partkey", *[F.array_join(F.transform(c, fixed), ";").alias(g) for g, c in groups.items()])
