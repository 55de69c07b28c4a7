"""One registered query per operator: its whole table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    bbit_minhash, covering_simhash, cyk_repair, fim_scatter, hilbert_shards, html_extract, line_rules, poisson_mix, prefix_decontam,
    tool_calls, toxic_crf, url_rules, word_first_langid)

HOST_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Whole names, a family of names, a path, user information in the host (a rule without a token), and what is always allowed.
PATTERN_RULES = (
    ("block", "^spam-farm^"), ("block", "^cheap-pills^"), ("block", "^casino-win^"), ("block", "^adult-x^"),
    ("block", "^ads-track^"), ("block", "^free-bets^"), ("block", "^casino-*.example.com/"), ("block", "/out/*/redirect^"),
    ("block", "@"), ("allow", "/robots.txt^"))

CALL_SCHEMAS = {
    "answer": {"text": {"type": "string", "required": True, "min_length": 1, "max_length": 2000},
               "length": {"type": "integer", "required": True, "min": 1}, "turn": {"type": "integer", "min": 0}},
    "configure": {"text": {"type": "string", "required": True}, "length": {"type": "integer"},
                  "turn": {"type": "integer", "max": 0}},
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op4(spark: SparkSession, folder: str) -> DataFrame:
    rules = url_rules.rules_table(spark, HOST_RULES, PATTERN_RULES)
    return url_rules.filter_urls(table(spark, folder, "pages"), rules)


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_text(table(spark, folder, "pages"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = tool_calls.calls_in(table(spark, folder, "conversations"))
    return tool_calls.link_tool_calls(calls, results, CALL_SCHEMAS)


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_shards.shard_digest(table(spark, folder, "documents"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])))
    return toxic_crf.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).withColumn(
        "spans", spans)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return covering_simhash.simhash_components(table(spark, folder, "documents"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return poisson_mix.replicate(table(spark, folder, "documents"), keep=["doc_id", "source"])


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return word_first_langid.identify_languages(table(spark, folder, "documents"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_decontam.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256")
    return line_rules.clean_documents(table(spark, folder, "documents")).select("*", digest).drop("clean_text", "lost_share")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return bbit_minhash.minhash_components(table(spark, folder, "documents"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return cyk_repair.repair_conversations(cyk_repair.damaged(table(spark, folder, "conversations")))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return fim_scatter.fim_digest(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1,
        "op2_tool_call_linking": op2,
        "op3_hilbert_shards": op3,
        "op4_url_filter": op4,
        "op5_toxic_spans": op5,
        "op6_simhash_near_dedup": op6,
        "op7_poisson_mixing": op7,
        "op8_language_id": op8,
        "op9_benchmark_decontamination": op9,
        "op10_quality_rules": op10,
        "op11_bbit_minhash": op11,
        "op12_conversation_repair": op12,
        "op13_fill_in_middle": op13,
    }
