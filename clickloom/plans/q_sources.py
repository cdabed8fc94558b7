"""Sources and sinks."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from clickloom.operators import fit, lookups
from clickloom.operators.sampling import count_values
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, IMPRESSIONS, behaviour, impressions, table
from clickloom.sources import tables, tfrecord
from clickloom.spec import CategoryField
from clickloom.storage import new_path


@query("src_parquet", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem")
def src_parquet(spark, sf):
    return tables.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_extendedprice"])


EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "dt"]


def _dated(spark, sf):
    path = new_path(spark, "dated-events")
    tables.write_dates(behaviour(spark, sf).select(*EVENT_COLUMNS), path)
    return path


@query(
    "src_partition_dates",
    f"WITH {BEHAVIOUR} SELECT event_id, user_id, event_type, value, dt FROM behaviour "
    "WHERE dt BETWEEN '20240105' AND '20240118'",
)
def src_partition_dates(spark, sf):
    return tables.read_dates(spark, _dated(spark, sf), "20240105", "20240118")


@query(
    "src_table",
    "SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey",
)
def src_table(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("clickloom_orders")
    return spark.sql(
        "SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total "
        "FROM clickloom_orders GROUP BY o_custkey"
    )


@query(
    "src_files_filtered",
    f"WITH {BEHAVIOUR} SELECT dt, CAST(1 AS BIGINT) AS n_files FROM behaviour GROUP BY dt",
)
def src_files_filtered(spark, sf):
    path = new_path(spark, "listed")
    tables.write_dates(behaviour(spark, sf).select(*EVENT_COLUMNS), path, files_per_day=1)
    dt = F.regexp_extract("path", r"dt=(\d+)", 1).alias("dt")
    return tables.list_files(spark, path).groupBy(dt).agg(F.count(F.lit(1)).alias("n_files"))


TF_COLUMNS = "dt, user_id, item_id, label_enter, CAST(amount AS FLOAT) AS amount, tag"


def _tf_rows(spark, sf):
    return impressions(spark, sf).select(
        "dt", "user_id", "item_id", "label_enter", F.col("amount").cast("float").alias("amount"), "tag",
        F.array(F.col("pred").cast("float"), F.col("tax").cast("float")).alias("vec"),
    )


def _round_trip(spark, sf):
    tfrecord.register(spark)
    rows = _tf_rows(spark, sf)
    path = new_path(spark, "tfrecord")
    rows.write.format("tfrecord").mode("overwrite").save(path)
    return spark.read.format("tfrecord").schema(rows.schema).load(path)


@query("src_tfrecord", f"WITH {IMPRESSIONS} SELECT {TF_COLUMNS}, CAST(pred AS FLOAT) AS v0, CAST(tax AS FLOAT) AS v1 FROM impressions")
def src_tfrecord(spark, sf):
    back = _round_trip(spark, sf)
    return back.select(*[c for c in back.columns if c != "vec"], F.get("vec", F.lit(0)).alias("v0"), F.get("vec", F.lit(1)).alias("v1"))


@query(
    "sink_tfrecord",
    f"WITH {IMPRESSIONS} SELECT dt, tag, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM impressions GROUP BY dt, tag",
)
def sink_tfrecord(spark, sf):
    return _round_trip(spark, sf).groupBy("dt", "tag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users")
    )


@query(
    "sink_parquet_partitioned",
    f"""WITH {BEHAVIOUR} SELECT event_id, dt, CASE WHEN dt < '20240124' THEN 'train' ELSE 'validation' END AS side
    FROM behaviour""",
)
def sink_parquet_partitioned(spark, sf):
    path = new_path(spark, "split")
    side = F.when(F.col("dt") < "20240124", "train").otherwise("validation")
    rows = behaviour(spark, sf).select(*EVENT_COLUMNS, side.alias("side"))
    tables.write_split(rows, path, "side", {"train": 7, "validation": 1})
    parts = [
        tables.read_dates(spark, f"{path}/{s}", "00000000", "99999999").select("event_id", "dt", F.lit(s).alias("side"))
        for s in ("train", "validation")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "repartition_write",
    """SELECT 'train' AS side, CAST(14 AS BIGINT) AS n_files, count(*) FILTER (ts < TIMESTAMP '2024-01-24') AS n_rows FROM events
    UNION ALL SELECT 'validation', CAST(2 AS BIGINT), count(*) FILTER (ts >= TIMESTAMP '2024-01-24') FROM events""",
)
def repartition_write(spark, sf):
    rows = behaviour(spark, sf).select("event_id", "dt")
    parts = []
    for side, n, cond in (
        ("train", 14, F.col("dt") < "20240124"),
        ("validation", 2, F.col("dt") >= "20240124"),
    ):
        path = new_path(spark, side)
        rows.where(cond).repartition(n).write.parquet(path)
        files = tables.list_files(spark, path).agg(F.count(F.lit(1)).alias("n_files"))
        counted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(side).alias("side"), files.scalar().alias("n_files"), "n_rows"))
    return parts[0].unionByName(parts[1])


BRANDS = "brands AS (SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1)"
RANKED = "vocab AS (SELECT value, count, row_number() OVER (ORDER BY count DESC, value) AS idx FROM brands)"


def _brand_vocab(spark, sf):
    return fit.fit_vocab(table(spark, sf, "part"), [CategoryField("p_brand")])


@query("sink_fitted", f"WITH {BRANDS}, {RANKED} SELECT 'p_brand' AS feature, value, count, idx FROM vocab")
def sink_fitted(spark, sf):
    path = new_path(spark, "fitted")
    parts = table(spark, sf, "part")
    fit.save_fitted(path, _brand_vocab(spark, sf), fit.fit_dense_stats(parts, {"p_retailprice": 0.0}))
    return fit.load_fitted(spark, path)[0]


DOC_LINES = """SELECT value, count(*) AS count FROM (
  SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS value
  FROM documents) GROUP BY value"""


def _doc_lines(spark, sf):
    path = new_path(spark, "lines")
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("value"))
    for part in (F.col("lang") == "en", F.coalesce(F.col("lang") != "en", F.lit(True))):
        tables.append_lines(lines.where(part).select("value"), path)
    return tables.read_lines(spark, path)


@query("src_lines", DOC_LINES)
def src_lines(spark, sf):
    return count_values(_doc_lines(spark, sf), "value", sort=False)


@query(
    "sink_lines",
    f"SELECT count(*) AS n_lines, sum(n) AS n_chars FROM (SELECT length(value) AS n FROM ({DOC_LINES.replace('count(*) AS count', '1').replace(' GROUP BY value', '')}))"
    .replace("SELECT value, 1 FROM", "SELECT value FROM"),
)
def sink_lines(spark, sf):
    return _doc_lines(spark, sf).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value").cast("decimal(38,0)")).alias("n_chars")
    )


STATS_SQL = """SELECT 'p_retailprice' AS feature, round(min(p_retailprice), 6) AS min, round(max(p_retailprice), 6) AS max,
  round(avg(p_retailprice), 4) AS mean FROM part UNION ALL
  SELECT 'p_size', round(min(p_size::DOUBLE), 6), round(max(p_size::DOUBLE), 6), round(avg(p_size), 4) FROM part"""


@query("src_json", STATS_SQL)
def src_json(spark, sf):
    """A statistics document written as one JSON text and read back."""
    stats = fit.fit_dense_stats(table(spark, sf, "part"), {"p_retailprice": -1.0, "p_size": -1.0})
    path = new_path(spark, "document")
    # one short entry per feature: the document is as large as the specification
    doc = stats.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("stats"))).alias("value"))
    doc.coalesce(1).write.text(path)
    rows = tables.read_document(spark, path).select(F.explode("stats").alias("s")).select("s.*")
    return rows.select("feature", "min", "max", F.round("mean", 4).alias("mean"))


FREQUENT = "kept AS (SELECT * FROM vocab WHERE count >= (SELECT avg(count) FROM vocab))"


def _frequent(spark, sf):
    vocab = _brand_vocab(spark, sf)
    return vocab.where(F.col("count") >= vocab.agg(F.avg("count")).scalar())


@query(
    "src_vocab_csv",
    f"""WITH {BRANDS}, {RANKED}, {FREQUENT}
    SELECT p_partkey, p_brand, CAST(coalesce(idx, 0) AS INT) AS brand_idx FROM part LEFT JOIN kept ON p_brand = value""",
)
def src_vocab_csv(spark, sf):
    path = new_path(spark, "vocab-csv")
    _frequent(spark, sf).select("idx", "value").write.csv(path)
    rows = table(spark, sf, "part").select("p_partkey", "p_brand")
    return lookups.index_by_vocab(rows, "p_brand", tables.read_vocab_csv(spark, path), "brand_idx")


@query(
    "src_vocab_txt",
    f"""WITH {BRANDS}, {RANKED}, {FREQUENT}
    SELECT p_partkey, p_brand, CAST(coalesce(idx - 1, 99) AS INT) AS brand_idx FROM part LEFT JOIN kept ON p_brand = value""",
)
def src_vocab_txt(spark, sf):
    path = new_path(spark, "vocab-txt")
    _frequent(spark, sf).select("value", (F.col("idx") - 1).alias("idx")).write.option("sep", " ").csv(path)
    rows = table(spark, sf, "part").select("p_partkey", "p_brand")
    default_numb = 100
    return lookups.index_by_vocab(
        rows, "p_brand", tables.read_vocab_txt(spark, path), "brand_idx", missing=default_numb - 1
    )


@query(
    "cache_dataset",
    f"WITH {BEHAVIOUR} SELECT user_id, day, count(*) AS n FROM behaviour GROUP BY user_id, day",
)
def cache_dataset(spark, sf):
    def build():
        return behaviour(spark, sf).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))

    task = f"daily{zlib.crc32(sf.encode())}"
    tables.cached_dataset(spark, task, 1024, "20240130", build)
    return tables.cached_dataset(spark, task, 1024, "20240130", build)


@query(
    "cache_by_content",
    f"""WITH {BEHAVIOUR}, cut AS (SELECT 'before' AS version, * FROM behaviour WHERE dt < '20240124' UNION ALL SELECT 'after', * FROM behaviour)
    SELECT version, user_id, day, count(*) AS n FROM cut GROUP BY version, user_id, day""",
)
def cache_by_content(spark, sf):
    """One name, two states of the input: the second is built anew, and each is found again."""
    events = behaviour(spark, sf).select("event_id", "user_id", "day", "dt")
    parts = []
    for version, rows in (("before", events.where(F.col("dt") < "20240124")), ("after", events)):
        for _ in range(2):
            made = tables.cached_dataset(
                spark, "by-content", 1024, "20240130",
                lambda: rows.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")), [rows],
            )
        parts.append(made.select(F.lit(version).alias("version"), "*"))
    return parts[0].unionByName(parts[1])


@query(
    "retention",
    "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS dt FROM orders WHERE strftime(o_orderdate, '%Y%m%d') <= '19971207'",
)
def retention(spark, sf):
    dates = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("dt"))
    return tables.expired_dates(dates, "19971231", 24)
