"""From raw documents to packed sequences: toxic, repeated and leaked documents go, the rest is packed.

Every stage reads what the one before has written.  All but the last return
the columns of documents; a null text is empty from the first stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import materialize, table
from clickloom.llm.decontaminate import contamination
from clickloom.llm.exact_dedup import exact_duplicates
from clickloom.llm.ngram_join import similarity_classes
from clickloom.llm.packing import best_fit, cut_documents
from clickloom.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = "stage_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key: doc_id, or a written number in its order where rows share or lack one."""
    docs = docs.select(*COLUMNS)
    twice = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if twice.isEmpty():
        return docs.withColumn(KEY, F.col("doc_id"))
    return materialize(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn(KEY, F.monotonically_increasing_id()), "stage")


def _by_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(KEY).alias("doc_id"), "text")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose key is not among ``dropped`` (key); written first, so that the join sees its size."""
    dropped = materialize(dropped.select(F.col("doc_id").alias(KEY)), "dropped")
    return docs.join(dropped, KEY, "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), keep=("lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id."""
    docs = _keyed(docs)
    return _without(docs, exact_duplicates(_by_key(docs)).where("NOT kept"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the row with the smallest doc_id; texts without words all stay."""
    docs = _keyed(docs)
    return _without(docs, similarity_classes(_by_key(docs)).where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    docs = _keyed(docs)
    return _without(docs, contamination(_by_key(docs), table(spark, sf_dir, "benchmark")).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, with the ids of each piece as a digest."""
    pieces = cut_documents(docs)
    return best_fit(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL has neither the classifier nor the tokenizer; tests/llm check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
