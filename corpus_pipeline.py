"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Quality rules take out rejected documents and the failed lines of the others, exact dedup keeps
the largest doc_id of equal texts, the n-gram join keeps the smallest doc_id of each group of
near duplicates, mixing repeats or leaves out documents by the target of their source, and
byte-level BPE encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cleaned_documents(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded"))


STAGES = [
    ("quality", quality_rules),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", near_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: Set joins with components and byte-pair encoding cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = store.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            store.release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
