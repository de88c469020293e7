"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and encoding, in this order.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet before the next
one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, lines, minhash, mixing, quality
from tallyforge.llm._common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rule or scores under the threshold."""
    judged = quality.assessed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each component of near-equal lines; n_chars follows the text. What is left of a document with fewer
    words than the base rule asks for goes: its lines live on elsewhere, and as a stub it would hide from near_dedup."""
    left = lines.deduplicated(docs, least_words=quality.LEAST_WORDS)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (shingles of five words, similarity 0.8 or more)."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources up to twice; every document stays once at least."""
    return mixing.mixed(docs, evenness=mixing.EVENNESS).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and tokens of each row, with the digests of its ids and of the text that they decode to."""
    return bpe.encode(docs, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The stages' hashes, MinHash candidates and BPE can't be said in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
