"""Training-data pipeline over ``documents``: language ID, exact dedup, near-duplicate removal, decontamination, packing.

Each stage takes all that the one before kept; its output is written as Parquet to the shared folder and read again, so a lost executor
costs the running stage only.

Every stage takes any columns beside ``doc_id``, ``text`` and ``lang`` and passes them on, whatever their names; an empty table stays empty. A null text counts as empty. What a stage does with
nulls, repeated rows and ties is said at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, exact_dedup, language_id, minhash_dedup, packing, work


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter, or without text, go. Repeated rows and rows without id or language are judged by their text alone."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest id stays; of rows that share that id too, one; of a group without any id, one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles are similar by 0.8 or more, the one with the smallest id stays; of rows that share id and words, one.

    Documents without id or without words are linked with nothing and stay.
    """
    return minhash_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go, each by its own text; rows without id or text are documents like others, empty passages are in none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 ids; a document without text is its end id, repeated rows are packed once each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Language models, sketches and retrieval are beyond SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs, path = work.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            work.release(spark, last)
        last = path
    return docs
