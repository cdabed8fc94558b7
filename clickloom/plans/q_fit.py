"""Fitting of vocabularies and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.operators import bands, evaluate, fit, refit
from clickloom.operators.apply import apply_spec
from clickloom.operators.sampling import count_values, date_list, get_date
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, IMPRESSIONS, behaviour, impressions, table
from clickloom.spec import CategoryField, DenseField, TokensField
from clickloom.storage import new_path


def vocab_sql(feature: str, counts: str, where: str = "true") -> str:
    return f"""SELECT '{feature}' AS feature, value, count, row_number() OVER (ORDER BY count DESC, value) AS idx
    FROM ({counts}) WHERE {where}"""


ITEM_COUNTS = "SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY 1"


@query("fit_vocab", vocab_sql("l_partkey", ITEM_COUNTS, "count >= 20 AND value <> '0'"))
def fit_vocab(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey")
    return fit.fit_vocab(rows, [CategoryField("l_partkey", default="0", min_cnt=20)])


@query(
    "fit_vocab_varlen",
    vocab_sql(
        "text",
        "SELECT value, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents) GROUP BY 1",
        "count >= 3",
    ),
)
def fit_vocab_varlen(spark, sf):
    """Words of whole documents."""
    return fit.fit_vocab(table(spark, sf, "documents").select("text"), [TokensField("text", sep=" ", max_len=2**31 - 1, min_cnt=3)])


def stats_sql(feature: str, col: str, default: str, source: str) -> str:
    x = f"CASE WHEN {col} <> {default} THEN CAST({col} AS DOUBLE) END"
    lx = f"CASE WHEN {col} <> {default} AND {col} > 0 THEN ln({col}) END"
    return f"""SELECT '{feature}' AS feature, round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(avg({x}), 6) AS mean,
    round(stddev_samp({x}), 6) AS stddev, round(avg({lx}), 6) AS log_mean, round(stddev_samp({lx}), 6) AS log_stddev FROM {source}"""


@query(
    "fit_dense_stats",
    f"WITH {IMPRESSIONS} "
    + " UNION ALL ".join(
        stats_sql(c, c, d, "impressions") for c, d in (("pred", "0"), ("duration", "1"), ("tax", "0.01"), ("score", "0"))
    ),
)
def fit_dense_stats(spark, sf):
    return fit.fit_dense_stats(impressions(spark, sf), {"pred": 0.0, "duration": 1.0, "tax": 0.01, "score": 0.0})


@query(
    "fit_dense_quantile95",
    f"""WITH {IMPRESSIONS} SELECT 'amount' AS feature, round(quantile_cont(amount, 0.95), 6) AS quantile FROM impressions
    UNION ALL SELECT 'pred', round(quantile_cont(pred, 0.95), 6) FROM impressions
    UNION ALL SELECT 'duration', round(quantile_cont(duration, 0.95), 6) FROM impressions""",
)
def fit_dense_quantile95(spark, sf):
    out = bands.exact_quantiles(impressions(spark, sf), ["amount", "pred", "duration"], 0.95)
    return out.withColumn("quantile", F.round("quantile", 6))


@query(
    "fit_ratio_param",
    "SELECT p_partkey, CASE WHEN p_size % 10 > 5 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS c FROM part",
)
def fit_ratio_param(spark, sf):
    size = F.size(F.array_repeat(F.lit(0), F.col("p_size") % 10))
    return table(spark, sf, "part").select("p_partkey", fit.ratio_param(size).alias("c"))


@query(
    "fit_all",
    " UNION ALL ".join(
        f"SELECT feature, value, count, idx, NULL::DOUBLE AS p, NULL::DOUBLE AS q FROM ({v})"
        for v in (
            vocab_sql("p_brand", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1"),
            vocab_sql("p_type", "SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1", "count >= 10 AND value <> 'PROMO'"),
            vocab_sql(
                "p_name",
                "SELECT value, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')[1:9]) AS value FROM part) GROUP BY 1",
            ),
        )
    )
    + """ UNION ALL SELECT 'p_retailprice', NULL, NULL, NULL, round(min(p_retailprice), 6), round(max(p_retailprice), 6) FROM part
    UNION ALL SELECT 'p_size', NULL, NULL, NULL, round(avg(p_size), 6), round(stddev_samp(p_size), 6) FROM part WHERE p_size <> 1""",
)
def fit_all(spark, sf):
    fields = [
        CategoryField("p_brand"),
        CategoryField("p_type", default="PROMO", min_cnt=10),
        TokensField("p_name", sep=" ", max_len=9),
        DenseField("p_retailprice", op="min_max", default=-1.0),
        DenseField("p_size", op="normal", default=1.0),
        DenseField("given", op="normal", p=0.0, q=1.0),
    ]
    vocab, stats = fit.fit_all(table(spark, sf, "part"), fields)
    pair = lambda a, b: F.when(F.col("feature") == "p_size", F.col(a)).otherwise(F.col(b))
    numbers = stats.select(
        "feature", F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("count"),
        F.lit(None).cast("long").alias("idx"), pair("mean", "min").alias("p"), pair("stddev", "max").alias("q"),
    )
    none = F.lit(None).cast("double")
    return vocab.select("feature", "value", "count", "idx", none.alias("p"), none.alias("q")).unionByName(numbers)


@query("count_values", "SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1")
def count_values_(spark, sf):
    return count_values(table(spark, sf, "part"), "p_name")


@query("sort_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def sort_counts(spark, sf):
    return count_values(table(spark, sf, "events"), "event_type")


@query(
    "topk_vocab",
    "SELECT * FROM (" + vocab_sql("l_partkey", ITEM_COUNTS, "value <> '0'") + ") WHERE idx <= 50 UNION ALL SELECT * FROM ("
    + vocab_sql("l_suppkey", "SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY 1", "value <> '0'")
    + ") WHERE idx <= 50",
)
def topk_vocab(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return fit.topk_vocab(rows, [CategoryField("l_partkey", default="0"), CategoryField("l_suppkey", default="0")], 50)


WEIGHTED = f"WITH {IMPRESSIONS} SELECT dt, "


@query("label_mean", WEIGHTED + "round(sum(label_enter * duration) / sum(duration), 6) AS label_mean FROM impressions GROUP BY dt")
def label_mean(spark, sf):
    return evaluate.losses(impressions(spark, sf), "label_enter", "score", ["dt"], "duration").select("dt", "label_mean")


@query("pred_mean", WEIGHTED + "round(sum(score * duration) / sum(duration), 6) AS pred_mean FROM impressions GROUP BY dt")
def pred_mean(spark, sf):
    return evaluate.losses(impressions(spark, sf), "label_enter", "score", ["dt"], "duration").select("dt", "pred_mean")


def _bounds_sql(col: str, buckets: int) -> str:
    """The values at the ranks ``ceil(i * n / buckets)``."""
    return f"""SELECT DISTINCT '{col}' AS feature, {col}::DOUBLE AS v FROM (SELECT {col}, row_number() OVER (ORDER BY {col}) AS r, count(*) OVER () AS n
      FROM impressions WHERE {col} <> 0) JOIN (SELECT unnest(range(1, {buckets})) AS i) ON r = (i * n + {buckets} - 1) // {buckets}"""


BOUNDS = "bounds AS (" + " UNION ALL ".join(_bounds_sql(c, k) for c, k in (("amount", 16), ("tax", 16), ("duration", 7))) + ")"
BUCKETED = [
    DenseField("amount", op="bucketize", buckets=16),
    DenseField("tax", op="bucketize", buckets=16),
    DenseField("duration", op="bucketize", buckets=7),
]


@query(
    "fit_boundaries",
    f"""WITH {IMPRESSIONS}, {BOUNDS} SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY v) AS INT) AS number, v AS bound
    FROM bounds""",
)
def fit_boundaries(spark, sf):
    """Equal-mass boundaries by exact rank; ``tax`` has fewer values than buckets."""
    out = fit.fit_boundaries(impressions(spark, sf), BUCKETED).select("feature", F.posexplode("bounds").alias("number", "bound"))
    return out.withColumn("number", F.col("number") + 1)


@query(
    "bucketize_fitted",
    f"""WITH {IMPRESSIONS}, {BOUNDS} SELECT order_id, line_no, item_id, """
    + ", ".join(
        f"(SELECT CAST(count(*) AS INT) FROM bounds WHERE feature = '{f.name}' AND v <= {f.name}) AS {f.name}" for f in BUCKETED
    )
    + " FROM impressions",
)
def bucketize_fitted(spark, sf):
    """Boundaries fitted, saved, loaded and applied with the specification."""
    rows = impressions(spark, sf)
    path = new_path(spark, "bounds")
    fit.fit_boundaries(rows, BUCKETED).write.parquet(f"{path}/bounds")
    ready = fit.with_boundaries(BUCKETED, fit.load_bounds(spark, path))
    return apply_spec(rows, ready, keep=["order_id", "line_no", "item_id"])


@query(
    "fit_boundaries_label",
    f"""WITH {IMPRESSIONS}, edges AS (SELECT DISTINCT v FROM ({_bounds_sql('amount', 32).replace('WHERE amount <> 0', '')})),
    sides AS (SELECT v, amount >= v AS above, count(*)::DOUBLE AS n, sum(label_enter)::DOUBLE AS pos
      FROM impressions JOIN edges ON true WHERE label_enter IS NOT NULL GROUP BY 1, 2),
    loss AS (SELECT v, sum(CASE WHEN pos > 0 THEN -pos * ln(pos / n) ELSE 0 END + CASE WHEN pos < n THEN -(n - pos) * ln((n - pos) / n) ELSE 0 END) AS l
      FROM sides GROUP BY v)
    SELECT 'amount' AS feature, v AS bound FROM loss ORDER BY l, v LIMIT 1""",
)
def fit_boundaries_label(spark, sf):
    """The one cut of the price that tells most about the label."""
    found = fit.fit_boundaries_by_label(impressions(spark, sf), ["amount"], "label_enter", 2, cells=32)
    return found.select("feature", F.explode("bounds").alias("bound"))


LAST, DAYS = "19970604", 60
FIRST = get_date(1 - DAYS, LAST)
REFIT = [CategoryField("source"), CategoryField("item_id", default="0", min_cnt=2), CategoryField("tag")]
REFIT_DENSE = {"amount": 0.0, "duration": 1.0}
WINDOW = f"(SELECT * FROM impressions WHERE dt BETWEEN '{FIRST}' AND '{LAST}')"


def _counted(col: str) -> str:
    return f"SELECT CAST({col} AS VARCHAR) AS value, count(*) AS count FROM {WINDOW} GROUP BY 1"


def _refitted(spark, sf):
    """The window of the day before, stored; then one day comes and one goes."""
    path, early, eve = new_path(spark, "refit"), get_date(-1, FIRST), get_date(-1, LAST)
    refit.add_days(impressions(spark, sf, early, eve), path, REFIT, REFIT_DENSE, date_list(early, eve, True))
    refit.window_counts(spark, path, eve, DAYS)
    refit.add_days(impressions(spark, sf, LAST, LAST), path, REFIT, REFIT_DENSE, [LAST])
    return path


@query(
    "refit_vocab",
    f"WITH {IMPRESSIONS} "
    + " UNION ALL ".join(
        vocab_sql(c, _counted(c), w) for c, w in (("source", "true"), ("item_id", "count >= 2 AND value <> '0'"), ("tag", "true"))
    ),
)
def refit_vocab(spark, sf):
    return refit.window_vocab(spark, _refitted(spark, sf), REFIT, LAST, DAYS)


@query(
    "refit_stats",
    f"WITH {IMPRESSIONS} " + " UNION ALL ".join(stats_sql(c, c, str(d), WINDOW) for c, d in REFIT_DENSE.items()),
)
def refit_stats(spark, sf):
    return refit.window_stats(spark, _refitted(spark, sf), LAST, DAYS)
