"""Evaluation metrics, and the flagship job."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import dense as D
from clickloom.operators import evaluate as E
from clickloom.operators import fit, lookups, sampling
from clickloom.operators import score as S
from clickloom.plans.q_joins import WORD_VOCAB, word_rows
from clickloom.plans.q_split import BY_ORDER, DAY, ORDER
from clickloom.plans.registry import query
from clickloom.plans.views import IMPRESSIONS, impressions, table
from clickloom.spec import CategoryField
from clickloom.storage import materialize


def auc_sql(source: str, label: str, score: str, by: str = "") -> str:
    """AUC from distinct scores; ``by`` is a list of group columns ending in a comma."""
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by} sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc, sum(p + n) AS n_rows FROM (
      SELECT *, coalesce(sum(n) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT {by} {score} AS s, CAST(sum({label}) AS DOUBLE) AS p, CAST(sum(1 - {label}) AS DOUBLE) AS n FROM {source} GROUP BY {by} s)) {group}"""


def gauc_sql(source: str, label: str, score: str, group: str, digits: int, by: str = "") -> str:
    tail = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by} round(sum(auc * n_rows) FILTER (auc IS NOT NULL) / sum(n_rows) FILTER (auc IS NOT NULL), {digits}) AS gauc,
      count(auc) AS n_groups FROM ({auc_sql(source, label, score, by + group + ', ')}) {tail}"""


@query(
    "auc_global",
    f"""WITH {IMPRESSIONS} SELECT 'pred' AS model, round(auc, 5) AS auc, CAST(n_rows AS BIGINT) AS n_rows FROM ({auc_sql('impressions', 'label_enter', 'pred')})
    UNION ALL SELECT 'score', round(auc, 5), CAST(n_rows AS BIGINT) FROM ({auc_sql('impressions', 'label_enter', 'score')})""",
)
def auc_global(spark, sf):
    """Once with many tied scores, once with nearly all scores different."""
    rows = impressions(spark, sf).select("label_enter", "pred", "score")
    parts = [E.auc_global(rows, "label_enter", s).select(F.lit(s).alias("model"), "auc", "n_rows") for s in ("pred", "score")]
    return parts[0].unionByName(parts[1])


@query("gauc", f"WITH {IMPRESSIONS} {gauc_sql('impressions', 'label_enter', 'pred', 'user_id', 5)}")
def gauc(spark, sf):
    return E.gauc(impressions(spark, sf), "label_enter", "pred", "user_id", 5)


@query("gauc_parallel", f"WITH {IMPRESSIONS} {gauc_sql('impressions', 'label_convert', 'score', 'user_id', 6)}")
def gauc_parallel(spark, sf):
    return E.gauc(impressions(spark, sf), "label_convert", "score", "user_id", 6)


LONG = """long AS (SELECT user_id, 'label_enter' AS task, label_enter AS y, pred AS s FROM impressions
  UNION ALL SELECT user_id, 'label_convert', label_convert, score FROM impressions)"""


@query(
    "auc_by_label",
    f"""WITH {IMPRESSIONS}, {LONG}, a AS ({auc_sql('long', 'y', 's', 'task, ')}), g AS ({gauc_sql('long', 'y', 's', 'user_id', 5, 'task, ')})
    SELECT task, round(auc, 5) AS auc, gauc FROM a JOIN g USING (task)""",
)
def auc_by_label(spark, sf):
    return E.auc_by_label(impressions(spark, sf), {"label_enter": "pred", "label_convert": "score"}, "user_id")


@query(
    "auc_binned",
    f"""WITH {IMPRESSIONS}, c AS (SELECT least(greatest(ceil(score * 199) - 1, 0), 198) AS cell, sum(label_enter) AS p, sum(1 - label_enter) AS n
      FROM impressions GROUP BY 1), k AS (SELECT *, sum(p) OVER (ORDER BY cell DESC) AS tp FROM c)
    SELECT round(sum((tp + tp - p) / 2 * n) / (sum(p) * sum(n)), 6) AS auc FROM k""",
)
def auc_binned(spark, sf):
    return E.auc_binned(impressions(spark, sf), "label_enter", "score")


CLIPPED = "least(greatest({}, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)"


def logloss_sql(label: str, pred: str) -> str:
    p = CLIPPED.format(pred)
    return f"round(avg(-({label} * ln({p}) + (1 - {label}) * ln(1 - {p}))), 6)"


@query("logloss", f"WITH {IMPRESSIONS} SELECT {logloss_sql('label_enter', 'pred')} AS logloss FROM impressions")
def logloss(spark, sf):
    return E.losses(impressions(spark, sf), "label_enter", "pred").select("logloss")


@query("mse", f"WITH {IMPRESSIONS} SELECT round(avg((label_enter - score) * (label_enter - score)), 6) AS mse FROM impressions")
def mse(spark, sf):
    return E.losses(impressions(spark, sf), "label_enter", "score").select("mse")


@query("mae", f"WITH {IMPRESSIONS} SELECT round(avg(abs(label_enter - score)), 6) AS mae FROM impressions")
def mae(spark, sf):
    return E.losses(impressions(spark, sf), "label_enter", "score").select("mae")


@query(
    "collect_pred_uid",
    f"WITH {IMPRESSIONS} SELECT user_id, label_enter, label_convert, round(score * pred, 6) AS p FROM impressions",
)
def collect_pred_uid(spark, sf):
    scored = impressions(spark, sf).withColumn("p", F.round(F.col("score") * F.col("pred"), 6))
    return E.aligned_predictions(scored, ["label_enter", "label_convert"], "p")


VERSIONS = """versions AS (SELECT user_id, label_enter AS y, 'yesterday' AS version, pred AS s FROM impressions
  UNION ALL SELECT user_id, label_enter, 'today', score FROM impressions)"""


@query(
    "compare_models",
    f"""WITH {IMPRESSIONS}, {VERSIONS}, a AS ({auc_sql('versions', 'y', 's', 'version, ')}), g AS ({gauc_sql('versions', 'y', 's', 'user_id', 5, 'version, ')}),
    l AS (SELECT version, {logloss_sql('y', 's')} AS logloss, count(*) AS n_rows FROM versions GROUP BY 1)
    SELECT version, round(auc, 5) AS auc, gauc, logloss, l.n_rows AS n_rows FROM a JOIN g USING (version) JOIN l USING (version)""",
)
def compare_models(spark, sf):
    rows = impressions(spark, sf)
    scored = E.unpivot_labels(
        rows.withColumns({"yesterday": F.col("label_enter"), "today": F.col("label_enter")}),
        {"yesterday": "pred", "today": "score"},
        ["user_id"],
    ).withColumnRenamed("task", "version")
    return E.compare_models(scored, "label", "score", "version", "user_id")


@query(
    "calibration",
    f"""WITH {IMPRESSIONS} SELECT CAST(least(floor(score * 10), 9) AS INT) AS bucket, count(*) AS n_rows,
    round(avg(score), 6) AS mean_pred, round(avg(label_enter), 6) AS mean_label FROM impressions GROUP BY 1""",
)
def calibration(spark, sf):
    return E.calibration(impressions(spark, sf), "label_enter", "score")


def deciles_sql(source: str, label: str, score: str, group: str = "") -> str:
    """Cells by rank, and their rising fit from the means of all runs of cells."""
    part = f"PARTITION BY {group}" if group else ""
    g, of = (f"{group}, ", lambda t: f"{t}.{group}, ") if group else ("", lambda t: "")
    same = lambda t, u: f"{t}.{group} = {u}.{group} AND " if group else ""
    return f"""placed AS (SELECT {g}{label} AS y, {score} AS s,
      CAST(floor((rank() OVER ({part} ORDER BY {score}) - 1) * 10 / count(*) OVER ({part})) AS INT) AS cell FROM {source}),
    cells AS (SELECT {g}cell, count(*) AS n_rows, sum(y) AS n_pos, avg(s) AS mean_pred FROM placed GROUP BY {g}cell),
    runs AS (SELECT {of('a')}a.cell AS i, b.cell AS j, sum(c.n_pos)::DOUBLE / sum(c.n_rows) AS m
      FROM cells a JOIN cells b ON {same('a', 'b')}a.cell <= b.cell
      JOIN cells c ON {same('a', 'c')}c.cell BETWEEN a.cell AND b.cell GROUP BY {of('a')}a.cell, b.cell),
    least AS (SELECT {of('k')}k.cell, r.i, min(r.m) AS m FROM cells k JOIN runs r
      ON {same('k', 'r')}r.i <= k.cell AND r.j >= k.cell GROUP BY {of('k')}k.cell, r.i),
    fitted AS (SELECT {g}cell, max(m) AS m FROM least GROUP BY {g}cell)
    SELECT {g}cell, n_rows, round(mean_pred, 6) AS mean_pred, round(n_pos / n_rows, 6) AS mean_label, round(m, 6) AS monotone
    FROM cells JOIN fitted USING ({g}cell)"""


@query("calibration_deciles", f"WITH {IMPRESSIONS}, {deciles_sql('impressions', 'label_enter', 'score')}")
def calibration_deciles(spark, sf):
    return E.calibration_deciles(impressions(spark, sf), "label_enter", "score")


@query("calibration_deciles_by", f"WITH {IMPRESSIONS}, {deciles_sql('impressions', 'label_enter', 'pred', 'source')}")
def calibration_deciles_by(spark, sf):
    """Deciles of a score with eleven values, per source: ties leave cells empty."""
    return E.calibration_deciles(impressions(spark, sf), "label_enter", "pred", by=["source"])


@query(
    "esmm_compose",
    f"WITH {IMPRESSIONS} SELECT order_id, line_no, item_id, score AS p1, round(score * pred, 9) AS p2, round(score * pred * tax, 9) AS p3 FROM impressions",
)
def esmm_compose(spark, sf):
    p1, p2, p3 = S.esmm_compose("score", "pred", "tax")
    return impressions(spark, sf).select(
        "order_id", "line_no", "item_id", p1.alias("p1"), F.round(p2, 9).alias("p2"), F.round(p3, 9).alias("p3")
    )


@query(
    "score_linear_sql",
    f"""WITH {WORD_VOCAB}, b AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS idx FROM part GROUP BY 1),
    t AS (SELECT p_partkey, sum((wv.idx % 7 - 3) / 10.0::DOUBLE) AS w FROM words JOIN wv USING (w) GROUP BY 1),
    l AS (SELECT p_partkey, 0.1::DOUBLE + (b.idx % 7 - 3) / 10.0::DOUBLE + t.w + p_retailprice * 0.0005::DOUBLE AS logit
      FROM part JOIN b USING (p_brand) JOIN t USING (p_partkey))
    SELECT p_partkey, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS pred FROM l""",
)
def score_linear_sql(spark, sf):
    """Explicit weights per fitted index: brand, name words, price and a bias."""
    rows = word_rows(spark, sf)
    brands = table(spark, sf, "part").select("p_partkey", "p_brand")
    vocab = fit.fit_vocab(brands, [CategoryField("p_brand")])
    rows = rows.join(lookups.index_by_vocab(brands, "p_brand", vocab, "brand_idx"), "p_partkey")
    weight = ((F.col("idx") % 7 - 3) / 10.0).alias("weight")
    words = rows.select(F.explode("word_ids").alias("idx")).distinct()
    weights = vocab.select(F.lit("brand_idx").alias("feature"), F.col("idx").cast("int"), weight).unionByName(
        words.select(F.lit("word_ids").alias("feature"), "idx", weight)
    )
    out = S.score_linear(
        rows, weights, ["brand_idx"], {"p_retailprice": 0.0005}, ["word_ids"], ["p_partkey"], bias=0.1
    )
    return out.select("p_partkey", F.round("logit", 6).alias("logit"), F.round("pred", 6).alias("pred"))


@query(
    "flagship",
    f"""WITH {IMPRESSIONS}, t AS (SELECT *, CASE WHEN dt < '19970603' THEN 'train'
      WHEN row_number() OVER (PARTITION BY dt ORDER BY {BY_ORDER}) <= floor(count(*) OVER (PARTITION BY dt) * 0.7::DOUBLE) THEN 'train'
      WHEN dt = '19970603' THEN 'dev' ELSE 'test' END AS split FROM impressions WHERE dt BETWEEN '19930705' AND '19970604'),
    st AS (SELECT round(avg(amount), 6) AS am, round(stddev_samp(amount), 6) AS asd, round(avg(duration), 6) AS dm,
      round(stddev_samp(duration), 6) AS dsd FROM t WHERE split = 'train'),
    v AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS idx FROM t WHERE split = 'train' GROUP BY 1),
    s AS (SELECT split, user_id, label_enter, round(2 * (amount - am) / asd - (duration - dm) / dsd + coalesce(idx, 0) * 0.1::DOUBLE, 4) AS s
      FROM t CROSS JOIN st LEFT JOIN v USING (source)),
    a AS ({auc_sql('s', 'label_enter', 's', 'split, ')}), g AS ({gauc_sql('s', 'label_enter', 's', 'user_id', 5, 'split, ')})
    SELECT split, round(auc, 5) AS auc, CAST(n_rows AS BIGINT) AS n_rows, gauc, n_groups FROM a JOIN g USING (split)""",
)
def flagship(spark, sf):
    """Split by date, fit on train, index and normalize, score, AUC and grouped AUC per split."""
    rows = impressions(spark, sf).select("dt", *ORDER, "user_id", "source", "duration", "label_enter")
    split = materialize(sampling.split_timeline(rows, DAY, 1430, [F.col(c).asc() for c in ORDER]), "split")
    train = split.where(F.col("split") == "train")
    stats = {r["feature"]: r for r in fit.fit_dense_stats(train, {"amount": -1.0, "duration": -1.0}).collect()}
    vocab = fit.fit_vocab(train, [CategoryField("source")])
    a, d = stats["amount"], stats["duration"]
    raw = (
        2 * D.normal("amount", a["mean"], a["stddev"])
        - D.normal("duration", d["mean"], d["stddev"])
        + F.col("source_idx") * 0.1
    )
    scored = lookups.index_by_vocab(split, "source", vocab, "source_idx").select(
        "split", "user_id", "label_enter", F.round(raw, 4).alias("s")
    )
    return E.ranking_report(scored, "label_enter", "s", "user_id", ["split"])
