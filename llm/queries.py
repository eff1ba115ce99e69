"""The operators as named queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm import twins
from llm.decontaminate import contaminated
from llm.embedding_neardup import embedding_neardup
from llm.filter_audit import filter_audit
from llm.html_text import extract_text
from llm.importance_resampling import resampling_table
from llm.language_id import identify
from llm.license_scan import license_scan
from llm.mixing import mix
from llm.ngram_jaccard import ngram_jaccard_join
from llm.substring_dedup import substring_dedup
from llm.token_count import token_counts
from llm.toxicity import toxicity
from llm.warc import archived


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_neardup(table(spark, folder, "embeddings"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, folder, "documents"), words=3, percent=90)


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents")).select("doc_id", "text", "n_sentences", "n_removed", "removed")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling_table(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = (op1_token_counts, op2_decontamination, op3_embedding_neardup, op4_license_scan, op5_ngram_jaccard_join,
           op6_html_extraction, op7_language_id, op8_mixing_sources, op9_substring_dedup, op10_toxicity,
           op11_importance_resampling, op12_warc, op13_filter_audit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_neardup": twins.OP3, "op5_ngram_jaccard_join": twins.OP5, "op11_importance_resampling": twins.OP11,
            "op12_warc": twins.OP12, "op13_filter_audit": twins.OP13}
