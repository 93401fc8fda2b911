"""The queries of this subpackage, one per operator, each over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from muralis.llm.bpe_codec import bpe_round_trip
from muralis.llm.fingerprints import fingerprint_documents
from muralis.llm.html_extract import extract_pages
from muralis.llm.near_dup import near_duplicate_classes
from muralis.llm.nearest import top_inner_products
from muralis.llm.packing import pack_documents
from muralis.llm.quality import classify_quality
from muralis.llm.suffix_dedup import repeated_byte_digest
from muralis.llm.suffix_tree_lm import lm_scores
from muralis.llm.token_counts import token_counts
from muralis.llm.token_store import token_file_digest
from muralis.llm.vector_codes import encode_vectors
from muralis.llm.whitening import whiten_embeddings
from muralis.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_byte_digest(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_top_k_search, op4_bpe_codec, op5_token_store, op6_fingerprints, op7_quality_classifier, op8_html_extraction, op9_near_duplicates, op10_best_fit_packing, op11_vector_codes, op12_lm_scoring, op13_whitening, pipeline)}

#: DuckDB SQL by query name. The operators here work by tokenizers, sketches, trees and trained models, or are too slow
#: in SQL on whole tables; tests/llm holds them against brute force instead.
ORACLE_SQL: dict[str, str] = {}
