"""Order, sampling, splitting and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import sampling as S
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, IMPRESSIONS, behaviour, impressions, table

ORDER = ["order_id", "line_no", "item_id", "owner_id", "amount"]
BY_ORDER = ", ".join(ORDER)


def _order():
    return [F.col(c).asc() for c in ORDER]


@query("shuffle_rows", "SELECT event_id, user_id, value FROM events")
def shuffle_rows(spark, sf):
    return S.shuffle_rows(behaviour(spark, sf).select("event_id", "user_id", "value"), ["event_id"], seed=42)


@query("sample_n", "SELECT event_id, user_id, value FROM events ORDER BY substr(md5('42:' || event_id), 1, 15), event_id LIMIT 500")
def sample_n(spark, sf):
    return S.sample_n(behaviour(spark, sf).select("event_id", "user_id", "value"), ["event_id"], 500, seed=42)


@query(
    "split_prefix",
    f"""WITH {IMPRESSIONS} SELECT user_id, {BY_ORDER}, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY {BY_ORDER})
      <= floor(count(*) OVER (PARTITION BY user_id) * 0.7::DOUBLE) THEN 'left' ELSE 'right' END AS side FROM impressions""",
)
def split_prefix(spark, sf):
    rows = impressions(spark, sf).select("user_id", *ORDER)
    return S.split_prefix(rows, 0.7, _order(), by=["user_id"])


DAY = "19970604"
TIMELINE = f"""t AS (SELECT dt, {BY_ORDER}, CASE WHEN dt < '19970603' THEN 'train'
    WHEN row_number() OVER (PARTITION BY dt ORDER BY {BY_ORDER}) <= floor(count(*) OVER (PARTITION BY dt) * 0.7::DOUBLE) THEN 'train'
    WHEN dt = '19970603' THEN 'dev' ELSE 'test' END AS split FROM impressions WHERE dt BETWEEN '19970521' AND '19970604')"""


@query("split_timeline", f"WITH {IMPRESSIONS}, {TIMELINE} SELECT * FROM t")
def split_timeline(spark, sf):
    return S.split_timeline(impressions(spark, sf, S.get_date(-14, DAY), DAY).select("dt", *ORDER), DAY, 14, _order())


@query(
    "split_simple",
    f"""WITH {IMPRESSIONS} SELECT dt, {BY_ORDER}, 'train' AS split FROM impressions WHERE dt >= '19970521' AND dt < '19970604'
    UNION ALL SELECT dt, {BY_ORDER}, s FROM impressions, (VALUES ('dev'), ('test')) v(s) WHERE dt = '19970604'""",
)
def split_simple(spark, sf):
    return S.split_simple(impressions(spark, sf, S.get_date(-14, DAY), DAY).select("dt", *ORDER), DAY, 14)


@query(
    "date_range_table",
    """SELECT strftime(unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE - 1, INTERVAL 3 DAY)), '%Y%m%d') AS dt FROM orders""",
)
def date_range_table(spark, sf):
    bounds = table(spark, sf, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last")
    )
    return S.date_range_table(bounds, "first", "last", step=3)


@query(
    "batch_rows",
    f"""WITH {IMPRESSIONS} SELECT dt, {BY_ORDER}, (row_number() OVER (PARTITION BY dt ORDER BY {BY_ORDER}) - 1) // 8 AS batch FROM impressions""",
)
def batch_rows(spark, sf):
    return S.batch_rows(impressions(spark, sf).select("dt", *ORDER), 8, _order(), by=["dt"])


@query("repeat_epochs", "SELECT event_id, value, CAST(e AS INT) AS epoch FROM events, range(3) r(e)")
def repeat_epochs(spark, sf):
    return S.repeat_epochs(table(spark, sf, "events").select("event_id", "value"), 3)


@query(
    "union_splits",
    f"WITH {BEHAVIOUR} SELECT event_id, dt FROM behaviour WHERE dt <= '20240110' OR dt >= '20240120'",
)
def union_splits(spark, sf):
    rows = behaviour(spark, sf).select("event_id", "dt")
    return S.union_splits(rows.where(F.col("dt") <= "20240110"), rows.where(F.col("dt") >= "20240120"))
