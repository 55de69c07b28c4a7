"""Building a corpus and question set from reading-comprehension rows.

Input rows: src_pos (stream position), id, title, context, question, answers (texts).
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import content_id
from rankloom.sources.jsonl import CORPUS_FILE, QUESTIONS_FILE, write_jsonl

log = logging.getLogger(__name__)


def first_positions(rows: DataFrame, key: str, position: str) -> DataFrame:
    """key, position of its first row.

    An aggregate of two small columns, not a window over rows: copies are reduced before
    the shuffle, so a key that holds a third of the rows still sends one row per task.
    """
    return rows.groupBy(key).agg(F.min(position).alias(position))


def first_occurrences(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of every key; positions are unique, so this join has no hot keys."""
    return rows.join(first_positions(rows, key, position), [key, position], "left_semi")


def build_from_rows(rows: DataFrame, n_docs: int | None = None, n_questions: int | None = None,
                    source: str = "reading-comprehension") -> tuple[DataFrame, DataFrame]:
    """(documents, questions): all distinct contexts and the questions on them, or the first of each."""
    keyed = rows.withColumn("doc_id", content_id(F.col("context")))
    kept = first_positions(keyed, "doc_id", "src_pos")
    if n_docs is not None:
        kept = kept.orderBy("src_pos").limit(n_docs)
    # positions are unique: the text side is not hashed again for this join
    documents = rows.join(kept, "src_pos", "left_semi").withColumn("doc_id", content_id(F.col("context"))).select(
        "doc_id", "title", F.col("context").alias("text"), F.lit(source).alias("source"),
        F.create_map(F.lit("source_title"), F.col("title")).alias("metadata"), "src_pos")
    asked = keyed if n_docs is None else keyed.join(kept, "doc_id", "left_semi")
    if n_questions is not None:
        asked = asked.orderBy("src_pos").limit(n_questions)
    questions = asked.select(
        F.col("id").alias("qid"), "question",
        F.coalesce(F.get("answers", F.lit(0)), F.lit("")).alias("answer"),
        F.array("doc_id").alias("relevant_doc_ids"), "src_pos")
    return documents, questions


# A small corpus of our own for smoke tests when no rows are at hand.
SAMPLE_DOCUMENTS = [
    ("Tides", "The moon pulls the oceans toward it. Most coasts see two high tides each day. "
              "Spring tides come when sun and moon line up."),
    ("Bread", "Yeast turns sugar into gas. The gas makes dough rise. Baking sets the crumb and "
              "browns the crust."),
    ("Bees", "Honey bees dance to tell others where food is. Workers gather nectar. The queen lays "
             "all the eggs of the hive."),
    ("Bridges", "An arch bridge carries its load as compression. A suspension bridge hangs its deck "
                "from cables under tension."),
    ("Glass", "Glass is made by melting sand with soda and lime. Slow cooling keeps it from cracking."),
    ("Clocks", "A pendulum keeps time by its length. Quartz clocks count the beats of a crystal."),
]
SAMPLE_QUESTIONS = [
    ("s1", "What pulls the oceans?", "The moon", "Tides"),
    ("s2", "When do spring tides come?", "When sun and moon line up", "Tides"),
    ("s3", "What makes dough rise?", "Gas", "Bread"),
    ("s4", "Who lays the eggs of the hive?", "The queen", "Bees"),
    ("s5", "How does an arch bridge carry its load?", "As compression", "Bridges"),
    ("s6", "Which material is melted to make glass?", "Sand", "Glass"),
    ("s7", "What do quartz clocks count?", "The beats of a crystal", "Clocks"),
]


def build_sample(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The built-in corpus; a question whose title is unknown has no relevant documents."""
    rows = [(i, *row) for i, row in enumerate(SAMPLE_DOCUMENTS)]
    documents = spark.createDataFrame(rows, "src_pos int, title string, text string").select(
        content_id(F.col("text")).alias("doc_id"), "title", "text", F.lit("builtin-sample").alias("source"),
        F.create_map(F.lit("sample"), F.lit("true")).alias("metadata"), "src_pos")
    asked = spark.createDataFrame(SAMPLE_QUESTIONS, "qid string, question string, answer string, title string")
    return documents.drop("src_pos"), link_by_title(asked, documents)


def link_by_title(questions: DataFrame, documents: DataFrame, position: str = "src_pos") -> DataFrame:
    """Replace a question's title by the id of the last document with that title."""
    ids = documents.groupBy("title").agg(F.max_by("doc_id", position).alias("doc_id"))
    found = F.when(F.col("doc_id").isNotNull(), F.array("doc_id")).otherwise(
        F.array().cast("array<string>"))
    return questions.join(ids, "title", "left").select(
        "qid", "question", "answer", found.alias("relevant_doc_ids"))


def dataset_summary(documents: DataFrame, questions: DataFrame) -> dict[str, float]:
    n_docs, mean_chars = documents.agg(F.count("*"), F.coalesce(F.avg(F.length("text")), F.lit(0.0))).first()
    return {"n_docs": n_docs, "n_questions": questions.count(), "mean_chars": mean_chars}


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path)
        return True
    except AnalysisException:
        return False


def build_dataset(spark: SparkSession, out_dir: str | Path, rows: DataFrame | None = None,
                  n_docs: int | None = None, n_questions: int | None = None,
                  force: bool = False) -> dict[str, float] | None:
    """Write corpus and questions; keeps existing files unless forced; the sample serves only where no rows are given."""
    corpus_path, questions_path = f"{out_dir}/{CORPUS_FILE}", f"{out_dir}/{QUESTIONS_FILE}"
    if not force and _exists(spark, corpus_path) and _exists(spark, questions_path):
        log.info("Dataset exists in %s; pass force to rebuild.", out_dir)
        return None
    if rows is None:
        log.warning("No source rows given; using the built-in sample.")
        documents, questions = build_sample(spark)
        write_jsonl(documents, corpus_path)
        write_jsonl(questions, questions_path)
    else:
        documents, questions = build_from_rows(rows, n_docs, n_questions)
        write_jsonl(documents.orderBy("src_pos").drop("src_pos"), corpus_path)
        write_jsonl(questions.orderBy("src_pos").drop("src_pos"), questions_path)
    return dataset_summary(documents, questions)
