"""Trailing-window features over the behaviour stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import trailing as W
from clickloom.operators.history import history, last_k_text
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, IMPRESSIONS, behaviour, ids, impressions


def over(n: int, by: str = "user_id") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def trail(measure: str, n: int, by: str = "user_id") -> str:
    return f"coalesce(sum({measure}) {over(n, by)}, 0)"


def _counts(*types):
    return {t: F.count_if(F.col("event_type") == t) for t in types}


USER_DAYS = f"""{BEHAVIOUR}, daily AS (SELECT user_id, day, count(*) FILTER (event_type = 'view') AS view,
  count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
  sum(value) AS total, count(value) AS n FROM behaviour GROUP BY 1, 2)"""


@query(
    "win_count",
    f"WITH {USER_DAYS}, pairs AS (SELECT user_id, item_id, day, count(*) AS view FROM behaviour GROUP BY 1, 2, 3) "
    + f"SELECT user_id, CAST(NULL AS INT) AS item_id, day, {', '.join(f'CAST({trail('view', n)} AS BIGINT) AS view_{n}d' for n in (14, 7, 3, 1))} FROM daily"
    + f" UNION ALL SELECT user_id, item_id, day, {', '.join(f'CAST({trail('view', n, 'user_id, item_id')} AS BIGINT)' for n in (14, 7, 3, 1))} FROM pairs",
)
def win_count(spark, sf):
    """Views per user, and events per (user, item) pair."""
    b, days = behaviour(spark, sf), (14, 7, 3, 1)
    users = W.trailing_counts(W.daily(b, ["user_id"], "day", _counts("view")), ["user_id"], "day", ["view"], days)
    pair = ["user_id", "item_id"]
    pairs = W.trailing_counts(W.daily(b, pair, "day", {"view": F.count(F.lit(1))}), pair, "day", ["view"], days)
    names = [f"view_{n}d" for n in days]
    return users.select("user_id", F.lit(None).cast("int").alias("item_id"), "day", *names).unionByName(
        pairs.select(*pair, "day", *names)
    )


@query(
    "win_ratio",
    f"WITH {USER_DAYS} SELECT user_id, day, "
    + ", ".join(f"round({trail('click', n)} / nullif({trail('view', n)}, 0), 6) AS click_ratio_{n}d" for n in (14, 3))
    + " FROM daily",
)
def win_ratio(spark, sf):
    daily = W.daily(behaviour(spark, sf), ["user_id"], "day", _counts("view", "click"))
    return daily.select(
        "user_id",
        "day",
        *[
            F.round(W.trailing_ratio(["user_id"], "day", "click", "view", n), 6).alias(f"click_ratio_{n}d")
            for n in (14, 3)
        ],
    )


def _values(spark, sf, keys):
    return W.daily(behaviour(spark, sf), keys, "day", {"total": F.sum("value"), "n": F.count("value")})


@query(
    "win_avg",
    f"WITH {USER_DAYS} SELECT user_id, day, round({trail('total', 14)} / nullif({trail('n', 14)}, 0), 9) AS avg_value_14d FROM daily",
)
def win_avg(spark, sf):
    ratio = W.trailing_ratio(["user_id"], "day", "total", "n", 14)
    return _values(spark, sf, ["user_id"]).select("user_id", "day", F.round(ratio, 9).alias("avg_value_14d"))


@query(
    "win_sum",
    f"""WITH {BEHAVIOUR}, daily AS (SELECT item_id, day, sum(value) AS total FROM behaviour GROUP BY 1, 2)
    SELECT item_id, day, round({trail('total', 21, 'item_id')}, 3) AS value_3w FROM daily""",
)
def win_sum(spark, sf):
    total = W.trailing_sum(["item_id"], "day", "total", 21)
    return _values(spark, sf, ["item_id"]).select("item_id", "day", F.round(total, 3).alias("value_3w"))


@query(
    "win_distinct",
    f"""WITH {BEHAVIOUR}, days AS (SELECT DISTINCT item_id, day FROM behaviour)
    SELECT d.item_id, d.day, count(DISTINCT user_id) AS users_7d FROM days d
    LEFT JOIN behaviour b ON b.item_id = d.item_id AND b.day BETWEEN d.day - 7 AND d.day - 1 GROUP BY 1, 2""",
)
def win_distinct(spark, sf):
    return W.trailing_distinct(behaviour(spark, sf), ["item_id"], "user_id", "day", 7, "users_7d")


@query(
    "win_active_days",
    f"""WITH {BEHAVIOUR}, daily AS (SELECT DISTINCT user_id, day, 1 AS one FROM behaviour)
    SELECT user_id, day, CAST({trail('one', 14)} AS BIGINT) AS active_14d FROM daily""",
)
def win_active_days(spark, sf):
    return W.trailing_active_days(behaviour(spark, sf), ["user_id"], "day", 14, "active_14d")


@query(
    "win_max_ratio",
    f"""WITH {BEHAVIOUR}, t AS (SELECT user_id, item_id, day, count(*) FILTER (event_type = 'click') AS click, count(*) AS shown
      FROM behaviour GROUP BY 1, 2, 3),
    s AS (SELECT user_id, item_id, t.day + k AS day, sum(click) AS p, sum(shown) AS w FROM t, range(1, 29) r(k) GROUP BY ALL)
    SELECT user_id, CAST(day AS INT) AS day, round(max(p / w), 6) AS max_ratio, round(avg(p / w), 6) AS avg_ratio FROM s GROUP BY ALL""",
)
def win_max_ratio(spark, sf):
    daily = W.daily(
        behaviour(spark, sf), ["user_id", "item_id"], "day",
        {"click": F.count_if(F.col("event_type") == "click"), "shown": F.count(F.lit(1))},
    )
    out = W.trailing_best_ratio(daily, "user_id", "item_id", "day", "click", "shown", 28)
    return out.select("user_id", "day", F.round("max_ratio", 6).alias("max_ratio"), F.round("avg_ratio", 6).alias("avg_ratio"))


@query(
    "win_hours",
    f"""WITH {BEHAVIOUR}, s AS (SELECT item_id, sec, count(*) FILTER (event_type = 'view') AS view, count(*) AS n FROM behaviour GROUP BY 1, 2)
    SELECT item_id, sec, CAST(coalesce(sum(view) OVER w, 0) AS BIGINT) AS view_12h, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS n_12h FROM s
    WINDOW w AS (PARTITION BY item_id ORDER BY sec RANGE BETWEEN 43200 PRECEDING AND 1 PRECEDING)""",
)
def win_hours(spark, sf):
    measures = {"view": F.count_if(F.col("event_type") == "view"), "n": F.count(F.lit(1))}
    return W.trailing_hours(behaviour(spark, sf), ["item_id"], "sec", 12, measures)


@query(
    "win_last_k",
    f"""WITH {BEHAVIOUR} SELECT event_id, coalesce(array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY us, event_id
    ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), ','), '') AS last_items FROM behaviour""",
)
def win_last_k(spark, sf):
    out = history(behaviour(spark, sf), "user_id", ["us", "event_id"], ["item_id"], 6)
    return out.select("event_id", last_k_text("hist_item_id").alias("last_items"))


@query(
    "win_map",
    f"WITH {BEHAVIOUR}, d AS (SELECT user_id, day, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("view", "click", "purchase"))
    + " FROM behaviour GROUP BY 1, 2), m AS (SELECT user_id, day, "
    + ", ".join(f"{trail(t, 7)} AS {t}" for t in ("view", "click", "purchase"))
    + """ FROM d) SELECT user_id, day, concat_ws(',', CASE WHEN click > 0 THEN 'click:' || click END,
    CASE WHEN purchase > 0 THEN 'purchase:' || purchase END, CASE WHEN view > 0 THEN 'view:' || view END) AS types_7d FROM m""",
)
def win_map(spark, sf):
    out = W.trailing_map(behaviour(spark, sf), ["user_id"], "event_type", ["view", "click", "purchase"], "day", 7, "m")
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return out.select("user_id", "day", F.array_join(entries, ",").alias("types_7d"))


BINS = (5.0, 10.0, 20.0, 40.0)


@query(
    "win_dist",
    f"""WITH {BEHAVIOUR}, d AS (SELECT user_id, day, count(*) FILTER (value < 5) AS b0, count(*) FILTER (value >= 5 AND value < 10) AS b1,
      count(*) FILTER (value >= 10 AND value < 20) AS b2, count(*) FILTER (value >= 20 AND value < 40) AS b3,
      count(*) FILTER (value >= 40) AS b4 FROM behaviour GROUP BY 1, 2)
    SELECT user_id, day, concat_ws(',', {', '.join(trail(f'b{i}', 7) for i in range(5))}) AS dist_7d FROM d""",
)
def win_dist(spark, sf):
    out = W.trailing_bins(behaviour(spark, sf), ["user_id"], "value", BINS, "day", 7, "dist")
    return out.select("user_id", "day", ids("dist").alias("dist_7d"))


@query(
    "smooth_ratio",
    f"WITH {USER_DAYS} SELECT user_id, day, round(({trail('click', 7)} + 1) / ({trail('view', 7)} + {trail('click', 7)} + 2), 6) AS smooth_7d FROM daily",
)
def smooth_ratio(spark, sf):
    daily = W.daily(behaviour(spark, sf), ["user_id"], "day", _counts("view", "click"))
    view, click = (W.trailing_sum(["user_id"], "day", m, 7) for m in ("view", "click"))
    return daily.select("user_id", "day", F.round(W.smooth_ratio(click, view + click), 6).alias("smooth_7d"))


@query(
    "pref_odds",
    f"""WITH {BEHAVIOUR}, d AS (SELECT user_id, day, count(*) FILTER (item_id < 50 AND event_type = 'click') AS ca,
      count(*) FILTER (item_id < 50) AS va, count(*) FILTER (item_id >= 50 AND event_type = 'click') AS cb,
      count(*) FILTER (item_id >= 50) AS vb FROM behaviour GROUP BY 1, 2),
    w AS (SELECT user_id, day, {', '.join(f'{trail(m, 14)} AS {m}' for m in ('ca', 'va', 'cb', 'vb'))} FROM d)
    SELECT user_id, day, round((ca + 1) / (va + 6), 6) AS ctr_low, round(((ca + 1) / (va + 6)) / ((cb + 1) / (vb + 6)), 6) AS odds_low FROM w""",
)
def pref_odds(spark, sf):
    """Click rate on one item group, and its odds against the other group."""
    low, click = F.col("item_id") < 50, F.col("event_type") == "click"
    daily = W.daily(
        behaviour(spark, sf), ["user_id"], "day",
        {"ca": F.count_if(low & click), "va": F.count_if(low), "cb": F.count_if(~low & click), "vb": F.count_if(~low)},
    )
    ca, va, cb, vb = (W.trailing_sum(["user_id"], "day", m, 14) for m in ("ca", "va", "cb", "vb"))
    return daily.select(
        "user_id", "day",
        F.round(W.smoothed_rate(ca, va), 6).alias("ctr_low"),
        F.round(W.preference_odds(ca, va, cb, vb), 6).alias("odds_low"),
    )


@query(
    "position_feature",
    f"""WITH {IMPRESSIONS} SELECT user_id, item_id, dt, CAST(greatest(0, least(299, min(line_no * 50))) AS INT) AS min_position_id
    FROM impressions GROUP BY 1, 2, 3""",
)
def position_feature(spark, sf):
    rows = impressions(spark, sf).withColumn("position", F.col("line_no") * 50)
    return W.first_position(rows, ["user_id", "item_id", "dt"], "position")


@query(
    "cum_stats",
    f"""WITH {USER_DAYS} SELECT user_id, day, CAST(coalesce(sum(click) OVER w, 0) AS BIGINT) AS click_cnt,
    CAST(coalesce(sum(purchase) OVER w, 0) AS BIGINT) AS purchase_cnt FROM daily
    WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def cum_stats(spark, sf):
    daily = W.daily(behaviour(spark, sf), ["user_id"], "day", _counts("click", "purchase"))
    return daily.select(
        "user_id", "day", *[W.lifetime(["user_id"], "day", m).alias(f"{m}_cnt") for m in ("click", "purchase")]
    )
