"""Dense transforms over the impressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import dense as D
from clickloom.plans.registry import query
from clickloom.plans.views import IMPRESSIONS, fixed, fixed_sql, impressions, table

KEYS = ["order_id", "line_no", "item_id"]


def _dense(name, sql, make):
    @query(name, f"WITH {IMPRESSIONS} SELECT order_id, line_no, item_id, {sql} FROM impressions")
    def run(spark, sf):
        return impressions(spark, sf).select(*KEYS, *[c.alias(n) for n, c in make().items()])


def _r(c):
    return F.round(c, 6)


_dense("dense_normal", "round((duration - 25.5) / 14.4, 6) AS x", lambda: {"x": _r(D.normal("duration", 25.5, 14.4))})
_dense(
    "dense_min_max",
    "round((duration - 1) / 49, 6) AS v1, round((duration - 0) / 15, 6) AS v2, CAST(NULL AS DOUBLE) AS flat",
    lambda: {
        "v1": _r(D.min_max("duration", 1, 50)),
        "v2": _r(D.min_max_v2("duration", 0, 15)),
        "flat": D.min_max("duration", 3, 3),
    },
)
_dense(
    "dense_log",
    """round(ln(abs(pred * 100 - 5) + 1), 6) AS v1, round(ln(pred + 1), 6) AS v2, round(ln(duration + 1) / ln(2), 6) AS base2""",
    lambda: {
        "v1": _r(D.log(F.col("pred") * 100 - 5)),
        "v2": _r(D.log_v2("pred")),
        "base2": _r(D.log_v2("duration", 2)),
    },
)
_dense(
    "dense_log_normal_v1",
    "round((ln(abs(duration) + 1) - ln(25.5)) / ln(14.4), 6) AS x",
    lambda: {"x": _r(D.log_normal("duration", 25.5, 14.4))},
)
_dense(
    "dense_log_normal_v2",
    "round((ln(duration + 1) - 2.97) / 0.93, 6) AS x",
    lambda: {"x": _r(D.log_normal_v2("duration", 2.97, 0.93))},
)
_dense("dense_sqrt", "round(sqrt(amount), 6) AS x", lambda: {"x": _r(D.sqrt("amount"))})
_dense("dense_clip", "least(greatest(duration, 10), 40) AS x", lambda: {"x": D.clip("duration", 10, 40)})
_dense("dense_add", "duration + 2.5 AS x", lambda: {"x": D.add("duration", 2.5)})
_dense("dense_divide", "duration / 8.0 AS x", lambda: {"x": D.divide("duration", 8.0)})
_dense("dense_identity", "amount AS x", lambda: {"x": D.identity("amount")})
_dense(
    "dense_to_float",
    "CAST(line_no AS FLOAT) AS x, CAST(user_id AS FLOAT) AS y",
    lambda: {"x": D.to_float("line_no"), "y": D.to_float("user_id")},
)
_dense(
    "dense_bucketize",
    "CASE WHEN amount < 1000 THEN 0 WHEN amount < 20000 THEN 1 WHEN amount < 60000 THEN 2 ELSE 3 END AS bucket",
    lambda: {"bucket": D.bucketize("amount", [1000, 20000, 60000])},
)


@query(
    "dense_ratio",
    f"""SELECT vec_id, {fixed_sql('[(CAST(y AS DOUBLE) + 1.0) / list_sum([CAST(z AS DOUBLE) + 1.0 for z in embedding]) for y in embedding]')} AS r
    FROM embeddings""",
)
def dense_ratio(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fixed(D.ratio("embedding", 1.0)).alias("r"))
