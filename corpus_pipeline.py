"""A training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch
from llm.decontaminate import decontaminate
from llm.language_id import keep_identified
from llm.mixing import mix
from llm.ngram_jaccard import ngram_jaccard_join
from llm.substring_dedup import substring_dedup

#: A text is rejected when its language is undetermined or this unsure.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null texts and texts of no clear language."""
    return keep_identified(docs, least_score=LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts with five-word Jaccard of 0.8 or more.

    Rows without id stay.  Of rows that repeat an id, each text is judged for itself: equal texts
    leave one row, and a text that links with nothing stays.
    """
    known = docs.where("doc_id is not null")
    repeated = not known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if not repeated:
        groups = ngram_jaccard_join(known, words=5, percent=80).where("doc_id = component_id").select("doc_id")
        return known.join(groups, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    row = "_row"
    while row in docs.columns:
        row += "_"
    named = known.withColumn(row, F.xxhash64("doc_id", "text"))
    found = ngram_jaccard_join(named, row, words=5, percent=80)
    first = named.select("doc_id", row).distinct().join(found.select(row, "component_id").distinct(), row).groupBy("component_id").agg(
        F.min(F.struct("doc_id", row))[row].alias(row))
    kept = named.join(first, row, "left_semi").dropDuplicates([row, "doc_id", "text"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated sentence runs out of the texts; a text that lost all its words goes."""
    found = substring_dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(left).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources", mixture),
]

#: The trained network of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = scratch.result(docs, f"stage-{k}")
    return docs
