"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Language ID drops documents without a letter or in none of the learned languages, line dedup cuts repeated lines (and documents that
lose all of them), MinHash keeps one document of each near-duplicate group, decontamination drops documents with benchmark
windows, and BPE encodes and decodes what is left. No stage but the last changes another column or drops rows for a null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderloom.llm import bpe, decontaminate, language_id, line_dedup, minhash_dedup
from tenderloom.llm.shared import stored
from tenderloom.llm.token_text import default_tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known(docs, language_id.fit(docs.where(~language_id.held_out())))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_copies(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.one_of_each(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("bpe", encode_documents),
]

#: SQL expresses neither the learned language filter nor BPE merges; tests hold every stage, and run(), against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
