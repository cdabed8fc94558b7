"""Sequences, sessions, negatives and query vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.functions import pooling as P
from clickloom.operators import history as H
from clickloom.operators.ranking import global_rank
from clickloom.plans.q_joins import word_rows
from clickloom.plans.q_pool import WORD_CELLS, word_pool
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, behaviour, fixed, ids
from clickloom.storage import materialize

ORDER = ["us", "event_id"]


@query(
    "hist_sequence",
    f"""WITH {BEHAVIOUR} SELECT event_id, coalesce(array_to_string(list(item_id) OVER w, ','), '') AS hist_item_id,
    coalesce(array_to_string(list(event_type) OVER w, ','), '') AS hist_event_type, CAST(count(*) OVER w AS INT) AS seq_length
    FROM behaviour WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def hist_sequence(spark, sf):
    out = H.history(behaviour(spark, sf), "user_id", ORDER, ["item_id", "event_type"], 20)
    return out.select(
        "event_id", ids("hist_item_id").alias("hist_item_id"), ids("hist_event_type").alias("hist_event_type"), "seq_length"
    )


@query(
    "neg_sequence",
    f"""WITH {BEHAVIOUR}, cat AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM behaviour)),
    pos AS (SELECT DISTINCT user_id, idx FROM behaviour JOIN cat USING (item_id)),
    free AS (SELECT user_id, list(item_id ORDER BY idx) AS f FROM (SELECT DISTINCT user_id FROM behaviour) u CROSS JOIN cat ANTI JOIN pos USING (user_id, idx) GROUP BY 1),
    h AS (SELECT event_id, user_id, CAST(count(*) OVER w AS INT) AS seq_length
      FROM behaviour WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT event_id, seq_length, array_to_string([f[(user_id * 104729 + event_id * 7919 + o * 1299709) % len(f) + 1] for o in range(seq_length)], ',')
      AS neg_hist_item_id FROM h LEFT JOIN free USING (user_id)""",
)
def neg_sequence(spark, sf):
    """For every step of a row's history an item its user never touched."""
    b = behaviour(spark, sf)
    catalog = global_rank(b.select(F.col("item_id").alias("item")).distinct(), [F.col("item").asc()], out="idx", unique=True)
    catalog = materialize(catalog.withColumn("idx", F.col("idx") - 1), "catalog")
    positives = b.join(catalog, b.item_id == catalog.item).select("user_id", "idx")
    rows = H.history(b, "user_id", ORDER, ["item_id"], 20).select("event_id", "user_id", "seq_length")
    steps = F.when(F.col("seq_length") > 0, F.sequence(F.lit(0), F.col("seq_length") - 1)).otherwise(F.array().cast("array<int>"))
    picks = F.transform(steps, lambda o: (F.col("user_id") * 104729 + F.col("event_id") * 7919 + o * 1299709).cast("long"))
    out = H.negative_history(rows, ["event_id"], "user_id", picks, positives, catalog, "neg")
    return out.select("event_id", "seq_length", ids("neg").alias("neg_hist_item_id"))


GAP = 12 * 3600 * 1_000_000


@query(
    "session_split",
    f"""WITH {BEHAVIOUR}, f AS (SELECT *, CASE WHEN us - lag(us) OVER w > {GAP} OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS opens
      FROM behaviour WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sess FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, sess ORDER BY us DESC, event_id DESC) AS back,
      max(sess) OVER (PARTITION BY user_id) AS n FROM s),
    k AS (SELECT user_id, sess - greatest(n - 5, 0) - 1 AS i, array_to_string(list(item_id ORDER BY us, event_id), ',') AS items
      FROM r WHERE back <= 10 AND sess > n - 5 GROUP BY user_id, sess, n)
    SELECT user_id, {', '.join(f"any_value(items) FILTER (i = {i}) AS sess_{i}_item_id" for i in range(5))},
    CAST(count(*) AS INT) AS sess_length FROM k GROUP BY user_id""",
)
def session_split(spark, sf):
    out = H.session_split(behaviour(spark, sf), "user_id", "us", ORDER, ["item_id"], GAP, max_len=10)
    names = [f"sess_{i}_item_id" for i in range(5)]
    return out.select("user_id", *[ids(c).alias(c) for c in names], "sess_length")


@query("target_query", f"WITH {WORD_CELLS} SELECT p_partkey, p AS query FROM ({word_pool('sum(x) / (count(*) + 1e-6::DOUBLE)')})")
def target_query(spark, sf):
    """Query vector of a multi-valued candidate: mean of its word vectors."""
    rows = word_rows(spark, sf).withColumn("mask", C.seq_mask("word_ids"))
    return rows.select("p_partkey", fixed(P.pool_mean("word_vecs", "mask", 64)).alias("query"))
