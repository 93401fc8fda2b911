"""A training corpus from ``documents``: four stages, each of which works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralis.llm.near_dup import near_duplicate_classes
from muralis.llm.packing import pack_documents
from muralis.llm.quality import classify_quality
from muralis.llm.suffix_dedup import remove_repeats
from muralis.storage import materialise, passing, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; null, blank, low-quality and toxic texts go."""
    with passing(spark):  # the features, which carry the texts, make room for the texts that are kept
        return materialise(classify_quality(docs, table(spark, sf_dir, "labels"), *COLUMNS).filter("keep").select(*COLUMNS), "kept", lasts=True)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates and exact copies: the one with the smallest doc_id.

    Rows without a doc_id stay. Different texts that share a doc_id are told apart; of rows that repeat the kept doc_id and
    text, the first in order stays.
    """
    heads = near_duplicate_classes(docs).filter("first and doc_id is not null").select("doc_id", "text_md5").distinct()
    rest = F.struct(*(c for c in COLUMNS if c != "doc_id"))
    # At most one text per class, so no group is large: repeats of one row only.
    kept = docs.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")))).join(heads, ["doc_id", "text_md5"])
    kept = kept.groupBy("doc_id", "text_md5").agg(F.min(rest).alias("r")).select("doc_id", "r.*").select(*COLUMNS)
    return kept.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur more than once; n_chars follows the text."""
    kept = remove_repeats(docs.filter("text is not null"), "lang", "source")
    kept = kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    return kept.unionByName(docs.filter("text is null").select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document and the sequences of 2048 tokens that they fill."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("repeated passages", remove_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Trained models, signatures, suffix arrays and tokenizers are not SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, after all stages have been applied to ``documents`` in turn."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
