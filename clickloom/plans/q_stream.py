"""The same features computed on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import fit
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, table
from clickloom.spec import CategoryField, DenseField
from clickloom.streaming import features as S


@query(
    "stream_features",
    """WITH v AS (SELECT event_type AS value, row_number() OVER (ORDER BY count(*) DESC, event_type) AS idx FROM events GROUP BY 1),
    s AS (SELECT round(avg(value::FLOAT::DOUBLE), 6) AS m, round(stddev_samp(value::FLOAT::DOUBLE), 6) AS sd FROM events WHERE value::FLOAT <> 0)
    SELECT event_id, round((events.value::FLOAT::DOUBLE - m) / sd, 5) AS value, CAST(idx AS INT) AS event_type
    FROM events JOIN v ON event_type = v.value CROSS JOIN s""",
)
def stream_features(spark, sf):
    """Fitted on the table, applied to the arriving files."""
    rows = table(spark, sf, "events").select(F.col("value").cast("float").alias("value"), "event_type")
    fields = [DenseField("value", op="normal", default=0.0), CategoryField("event_type")]
    vocab, stats = fit.fit_all(rows, fields)
    stream = S.parquet_stream(spark, sf, "events.parquet")
    out = S.stream_features(
        stream, {"value": "Float32", "event_type": "String"}, {"value": 0.0, "event_type": ""},
        fit.with_parameters(fields, stats), vocab, keep=["event_id"],
    )
    return S.run_to_table(out, "stream-features").withColumn("value", F.round("value", 5))


@query(
    "stream_counts",
    f"""WITH {BEHAVIOUR}, w AS (SELECT item_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start FROM behaviour, range(12) r(k)),
    mark AS (SELECT max(ts) - INTERVAL 30 MINUTE AS mark FROM behaviour)
    SELECT CAST(epoch(start) AS BIGINT) AS start_sec, item_id, count(*) FILTER (event_type = 'view') AS view, count(*) AS n
    FROM w, mark WHERE start + INTERVAL 12 HOUR <= mark GROUP BY 1, 2""",
)
def stream_counts(spark, sf):
    """12-hour counts every hour; windows the watermark has passed are final."""
    events = S.parquet_stream(spark, sf, "events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
    )
    counts = S.stream_counts(
        events, "ts", ["item_id"],
        {"view": F.count_if(F.col("event_type") == "view"), "n": F.count(F.lit(1))},
    )
    done = S.run_to_table(counts, "stream-counts")
    return done.select(F.unix_timestamp("start").alias("start_sec"), "item_id", "view", "n")
