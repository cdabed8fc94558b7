"""Daily refitting over a trailing window without reading the window again.

Every day leaves two small tables: its counts ``(feature, value, count)`` and
its moments (one row per column).  A window's counts are those of the window
one day earlier, plus the day that came, less the day that went; its moments
are merged from one row per column and day.  Both equal a fit from scratch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.operators.fit import number_vocab, value_counts
from clickloom.operators.sampling import get_date
from clickloom.spec import CategoryField, TokensField

COUNTS = "feature string, value string, count long"
MOMENTS = (
    "feature string, n long, mean double, m2 double, min double, max double, log_n long, log_mean double, log_m2 double"
)


def day_moments(df: DataFrame, defaults: Mapping[str, float], by: Sequence[str] = ("dt",)) -> DataFrame:
    """``(by..., feature, moments)`` of every column and of its logarithm, in one aggregation."""

    def sums(c: str, d: float):
        x = F.when(F.col(c) != F.lit(d), F.col(c)).cast("double")
        lx = F.ln(x)
        parts = {
            "n": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "min": F.min(x), "max": F.max(x),
            "log_n": F.count(lx), "log_mean": F.avg(lx), "log_m2": F.var_pop(lx) * F.count(lx),
        }
        return F.struct(F.lit(c).alias("feature"), *[e.alias(n) for n, e in parts.items()])

    one = df.groupBy(*by).agg(F.array(*[sums(c, d) for c, d in defaults.items()]).alias("a"))
    return one.select(*by, F.explode("a").alias("r")).select(*by, "r.*")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _is_written(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def add_days(
    rows: DataFrame, path: str, fields: Sequence[CategoryField | TokensField], defaults: Mapping[str, float], days: Sequence[str]
) -> None:
    """Count the given days of ``rows`` (column ``dt``) and store them; days stored before are replaced.

    Totals that a replaced day went into are dropped, so that the next window
    is added up from its days again.  A day without rows keeps what it had.
    """
    spark = rows.sparkSession
    fs, totals = _hadoop(spark, f"{path}/totals")
    if any(fs.exists(_hadoop(spark, f"{path}/counts/dt={d}")[1]) for d in days):
        fs.delete(totals, True)
    own = rows.where(F.col("dt").isin(list(days)))
    for name, made in (("counts", value_counts(own, fields, ["dt"])), ("moments", day_moments(own, defaults))):
        writer = made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt")
        writer.parquet(f"{path}/{name}")


def _days(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """The stored days ``first .. last``; other days' files are pruned."""
    return spark.read.schema(f"{schema}, dt string").parquet(path).where(F.col("dt").between(first, last))


def window_counts(spark: SparkSession, path: str, last: str, n: int) -> DataFrame:
    """``(feature, value, count)`` of the ``n`` days that end with ``last``, stored once.

    Three tables are read where the window of the day before is stored: that
    one, the day that came and the day that went; else the window's days.
    """
    done = f"{path}/totals/n={n}/until={last}"
    if not _is_written(spark, done):
        before = f"{path}/totals/n={n}/until={get_date(-1, last)}"
        first = get_date(1 - n, last)
        if _is_written(spark, before):
            gone = get_date(-1, first)
            parts = (
                spark.read.schema(COUNTS).parquet(before)
                .unionByName(_days(spark, f"{path}/counts", COUNTS, last, last).drop("dt"))
                .unionByName(_days(spark, f"{path}/counts", COUNTS, gone, gone).drop("dt").withColumn("count", -F.col("count")))
            )
        else:
            parts = _days(spark, f"{path}/counts", COUNTS, first, last).drop("dt")
        total = parts.groupBy("feature", "value").agg(F.sum("count").alias("count"))
        total.where(F.col("count") > 0).write.mode("overwrite").parquet(done)
    return spark.read.schema(COUNTS).parquet(done)


def window_vocab(
    spark: SparkSession, path: str, fields: Sequence[CategoryField | TokensField], last: str, n: int
) -> DataFrame:
    """The vocabulary ``fit_vocab`` finds on the window's rows."""
    return number_vocab(window_counts(spark, path, last, n), fields)


def window_stats(spark: SparkSession, path: str, last: str, n: int, digits: int = 6) -> DataFrame:
    """The statistics ``fit_dense_stats`` finds on the window's rows, from one row per column and day."""
    rows = _days(spark, f"{path}/moments", MOMENTS, get_date(1 - n, last), last)
    whole = Window.partitionBy("feature")
    for p in ("", "log_"):
        mean = F.try_divide(F.sum(F.col(f"{p}n") * F.col(f"{p}mean")).over(whole), F.sum(f"{p}n").over(whole))
        away = F.col(f"{p}mean") - F.col(f"_{p}mean")
        rows = rows.withColumn(f"_{p}mean", mean).withColumn(f"_{p}m2", F.col(f"{p}m2") + F.col(f"{p}n") * away * away)

    def spread(p: str):
        return F.sqrt(F.try_divide(F.sum(f"_{p}m2"), F.sum(f"{p}n") - 1))

    parts = {
        "min": F.min("min"), "max": F.max("max"), "mean": F.first("_mean"), "stddev": spread(""),
        "log_mean": F.first("_log_mean"), "log_stddev": spread("log_"),
    }
    return rows.groupBy("feature").agg(*[F.round(e, digits).alias(c) for c, e in parts.items()])
