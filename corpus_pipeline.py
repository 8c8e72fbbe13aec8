"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common, mixing, packing, quality, repeats, shingle_join
from linkspark.operators import storage

#: Near-duplicates: five words to a shingle, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def ready(spark: SparkSession) -> None:
    """Ready a session for a stage, whose executors begin without the memory that stages before took."""
    common.tune(spark)
    common.give_back_heap(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    ready(spark)
    return quality.filter_kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id; rows without an id stay."""
    ready(spark)
    linked = shingle_join.link(docs, SHINGLE_WORDS, SIMILARITY)
    extra = storage.materialize(linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())  # so that its size is known, and documents aren't shuffled for a few ids
    return docs.join(extra, F.col("doc_id") == F.col("_gone"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document has."""
    ready(spark)
    left = repeats.strip(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights ask."""
    ready(spark)
    return mixing.apply(docs, common.table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    ready(spark)
    return packing.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: SQL can't express the tokenisers, the suffix arrays and the fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage wrote on its way goes when its result is written, and that when the next one's is."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with storage.scratch(spark):
            result = stage(spark, docs, sf_dir)
            path = storage.write(result, keep=True)
        if before:
            storage.delete(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
