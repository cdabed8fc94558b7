"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so (a line or sentence end, at least
``MIN_CHUNK`` characters after the last cut, at most ``MAX_CHUNK``), so equal
texts have equal chunks.  A chunk's identifier is its 64-bit hash, verified:
every distinct (hash, chunk) pair meets once in a shuffle that first drops
repeats in the map tasks; where one hash has several chunks, a number among
them is added.  Documents are equal when their ordered identifier lists are.
Only these lists move from then on, never the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import materialize, table, whole_text
from clickloom.plans.registry import Query

MIN_CHUNK, MAX_CHUNK = 256, 4096
#: Lazy: the first line or sentence end after the least length, else the greatest length, else the rest.
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 2}}}?(?:\n|[.!?] )|.{{1,{MAX_CHUNK}}}"


def normal_text(column: str = "text") -> Column:
    """A-Z lower-cased, nothing else changed; null is empty."""
    return F.translate(whole_text(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null: empty) the row with the largest
    doc_id stays; of repeated rows with one doc_id, one stays.  Rows without a
    doc_id stay only if all their group lack one.  ``bits`` shortens the hash
    of chunks (tests use it to meet collisions).  Other columns are left out.
    """
    mask = (1 << bits) - 1 if bits < 64 else -1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_text().alias("text"))
    chunks = F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0))
    recipes = materialize(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(chunks, lambda c: F.xxhash64(c).bitwiseAND(F.lit(mask))).alias("recipe"),
        ),
        "recipes",
    )
    pieces = texts.select(F.explode(chunks).alias("chunk"))
    distinct = pieces.select(F.xxhash64("chunk").bitwiseAND(F.lit(mask)).alias("hash"), "chunk").distinct()
    shared = materialize(distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "chunk-hashes")
    if shared.isEmpty():  # each hash stands for one chunk
        numbered = recipes.withColumn("numbers", F.lit(None).cast("array<int>"))
    else:
        by_hash = Window.partitionBy("hash").orderBy("chunk")
        number = distinct.join(shared, "hash").withColumn("number", F.row_number().over(by_hash))
        at = texts.select(F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks).alias("at", "chunk")).distinct()
        found = at.withColumn("hash", F.xxhash64("chunk").bitwiseAND(F.lit(mask))).join(number, ["hash", "chunk"])
        lists = found.groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("at", "number"))).alias("numbers"))
        numbered = recipes.join(lists.withColumn("numbers", F.col("numbers.number")), "text_sha256", "left")
    identity = numbered.select("row", "doc_id", "text_sha256", F.struct("recipe", F.coalesce("numbers", F.array()).alias("numbers")).alias("identity"))
    groups = identity.groupBy("identity").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("keep"), F.count("*").alias("group_size"))
    # one row a group with copies; written, so that the join sees its size and can split the copies of a large group
    groups = materialize(groups.where("group_size > 1"), "groups")
    last = F.coalesce(F.col("keep.row") == -F.col("row"), F.lit(True))
    return identity.join(groups, "identity", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        last.alias("kept"),
        "text_sha256",
        "row",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
WINDOW g AS (PARTITION BY t)
"""
QUERIES: dict[str, tuple[Query, str | None]] = {"op4_exact_dedup": (op4_exact_dedup, SQL)}
