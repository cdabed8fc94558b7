"""The given tables seen as recommender data, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_MICROS = 86_400 * MICROS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # the times in the tables carry no zone: UTC has no gaps, so they stay as written
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, F.col(ts).cast("timestamp_ntz"))


def impressions(spark: SparkSession, sf: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row per shown item: line items joined to their order (user and day).

    The days ``first`` to ``last`` (yyyyMMdd) are compared with the stored time,
    so that they reach the scan, which a condition on the made ``dt`` does not.
    """
    o = table(spark, sf, "orders")
    kind = o.schema["o_orderdate"].dataType  # literals of the stored type leave the column bare
    if first:
        o = o.where(F.col("o_orderdate") >= F.to_date(F.lit(first), "yyyyMMdd").cast(kind))
    if last:
        o = o.where(F.col("o_orderdate") < F.date_add(F.to_date(F.lit(last), "yyyyMMdd"), 1).cast(kind))
    li = table(spark, sf, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.date_format("o_orderdate", "yyyyMMdd").alias("dt"),
        F.col("o_orderdate").alias("ts"),
        F.col("l_shipdate").alias("ship_ts"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("owner_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_returnflag") == "R").cast("int").alias("label_enter"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).cast("int").alias("label_convert"),
        F.col("l_discount").alias("pred"),
        (F.col("l_extendedprice") / (F.col("l_extendedprice") + 40000.0)).alias("score"),
        F.col("l_quantity").alias("duration"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("tag"),
        F.col("o_orderpriority").alias("source"),
    )


IMPRESSIONS = """impressions AS (
  SELECT strftime(o_orderdate, '%Y%m%d') AS dt, o_orderdate AS ts, l_shipdate AS ship_ts,
         o_custkey AS user_id, l_partkey AS item_id, l_suppkey AS owner_id,
         o_orderkey AS order_id, l_linenumber AS line_no,
         CAST(l_returnflag = 'R' AS INT) AS label_enter,
         CAST(l_returnflag = 'R' AND l_linestatus = 'F' AS INT) AS label_convert,
         l_discount AS pred, l_extendedprice / (l_extendedprice + 40000.0::DOUBLE) AS score,
         l_quantity AS duration, l_extendedprice AS amount, l_tax AS tax,
         l_returnflag AS tag, o_orderpriority AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def behaviour(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream with item, microseconds, seconds and day number."""
    e = table(spark, sf, "events").withColumn("us", micros("ts"))
    return e.select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        "us",
        F.floor(F.col("us") / MICROS).alias("sec"),
        F.floor(F.col("us") / DAY_MICROS).cast("int").alias("day"),
        F.date_format("ts", "yyyyMMdd").alias("dt"),
    )


BEHAVIOUR = """behaviour AS (
  SELECT event_id, user_id, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS item_id,
         epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec,
         CAST(epoch_us(ts) // 86400000000 AS INT) AS day, strftime(ts, '%Y%m%d') AS dt
  FROM events)"""


def fixed(vec: Column | str) -> Column:
    """A vector as text of rounded millionths, which compares exactly."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.array_join(F.transform(v, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ",")


def fixed_sql(vec: str) -> str:
    return f"array_to_string([CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) for x in {vec}], ',')"


def ids(arr: Column | str) -> Column:
    """An integer array as text."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(a.cast("array<string>"), ",")


def field_vectors(spark: SparkSession, sf: str, k: int = 8, d: int = 8) -> DataFrame:
    """Every stored embedding cut into ``k`` field vectors ``f0 .. f<k-1>``."""
    e = table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select("vec_id", "label", *[F.slice(v, i * d + 1, d).alias(f"f{i}") for i in range(k)])


def field_vectors_sql(k: int = 8, d: int = 8) -> str:
    cols = ", ".join(f"CAST(embedding[{i * d + 1}:{(i + 1) * d}] AS DOUBLE[]) AS f{i}" for i in range(k))
    return f"fields AS (SELECT vec_id, label, {cols} FROM embeddings)"
