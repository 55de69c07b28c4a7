"""The corpus pipeline: five stages, each one of the operators in llm/, each working on all its predecessor kept."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from llm import hilbert_shards, near_dedup, poisson_mix, prefix_decontam, word_first_langid
from rankloom.runtime import remove_table, write_alone


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or without a recognisable language go."""
    return word_first_langid.keep_identified(docs, word_first_langid.train(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return prefix_decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def poisson_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target share asks."""
    return poisson_mix.replicate(docs).select(*docs.columns)


def hilbert_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return hilbert_shards.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("poisson_mixing", poisson_mixing),
    ("hilbert_sharding", hilbert_sharding),
]

#: Language ID, sketches and the curve are Python; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again.

    A stage's intermediate tables go when its rows are written, its rows when the next stage's are.  Null texts and
    texts without letters go with the first stage; repeated rows are groups of copies; an empty table gives an empty
    result; other columns stay as they are, those of clashing names too.
    """
    docs, behind = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path, docs = write_alone(spark, name, partial(stage, spark, docs, sf_dir))
        if behind:
            remove_table(spark, behind)
        behind = path
    return docs
