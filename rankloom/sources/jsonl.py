"""JSON-lines corpora and question sets."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import schemas
from rankloom.config import get_config
from rankloom.functions import text as tx
from rankloom.runtime import broadcast_if_small, materialize

CORPUS_FILE = "corpus.jsonl"
QUESTIONS_FILE = "qa.jsonl"
BROKEN = "_broken"


def resolve_path(path: str | Path | None, filename: str, spark: SparkSession | None = None) -> str:
    """None means the configured data folder; a folder gets *filename*; a file, or a folder of part files, stays.

    The file system that holds the path says what it is; a path that does not exist is taken for a folder unless
    its name ends like a JSON file.
    """
    chosen = str(path) if path is not None else get_config().data_dir
    inside = f"{chosen.rstrip('/')}/{filename}"
    if spark is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        system = hadoop(chosen).getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(hadoop(chosen)):
            parts = system.getFileStatus(hadoop(chosen)).isDirectory() and not system.globStatus(hadoop(f"{chosen.rstrip('/')}/part-*"))
            return inside if parts else chosen
    return chosen if chosen.endswith((".jsonl", ".json")) else inside


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line of one or more text files.

    Large files are split by Spark; a split numbers its own lines, and the lines of the splits before it, counted in
    a narrow pass, are added.  So the number of tasks grows with the files, and no file passes through one task.
    """
    lines = materialize(spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id")), "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split.
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")).select(
        "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    return lines.join(broadcast_if_small(materialize(splits, "splits")), ["file", "block"]).select(
        "file", (F.col("id") - F.col("first") + F.col("skipped") + 1).alias("line"), "value")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict read with src_pos (file and line): blank lines are skipped, broken lines and missing fields raise, named by place."""
    try:
        lines = numbered_lines(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(
                f"{path} does not exist; build the dataset first (rankloom build-dataset).") from error
        raise
    fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema] + [T.StructField(BROKEN, T.StringType())])
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    rows = lines.where(~tx.is_blank(F.col("value"))).select(
        place.alias("place"), F.concat_ws(":", "file", F.lpad(F.col("line").cast("string"), 12, "0")).alias("src_pos"),
        F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("row"))

    def checked(field: T.StructField):
        value = F.col(f"row.{field.name}")
        broken = F.when(F.col("row").isNull() | F.col(f"row.{BROKEN}").isNotNull(),
                        F.raise_error(F.concat("place", F.lit(": malformed line"))))
        if not field.nullable:
            broken = broken.when(value.isNull(), F.raise_error(F.concat("place", F.lit(f": field {field.name} is missing"))))
        return broken.otherwise(value).alias(field.name)

    return rows.select("src_pos", *(checked(f) for f in schema))


def load_corpus(spark: SparkSession, path: str | Path | None = None) -> DataFrame:
    """Documents with their place (src_pos sorts by file and line); title, source and metadata may be absent."""
    rows = _read(spark, resolve_path(path, CORPUS_FILE, spark), schemas.DOCUMENTS)
    return rows.select(
        "doc_id",
        F.coalesce("title", F.lit("")).alias("title"),
        "text",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        "src_pos",
    )


def load_questions(spark: SparkSession, path: str | Path | None = None) -> DataFrame:
    """Questions with their answers, the ids of their relevant documents and their place."""
    rows = _read(spark, resolve_path(path, QUESTIONS_FILE, spark), schemas.QUESTIONS)
    return rows.select(
        "qid", "question", "answer",
        F.coalesce("relevant_doc_ids", F.array().cast("array<string>")).alias("relevant_doc_ids"), "src_pos")


def qrels_of(questions: DataFrame) -> DataFrame:
    """qid, doc_id: one row per relevant document."""
    return questions.select("qid", F.explode("relevant_doc_ids").alias("doc_id")).distinct()


def first_questions(questions: DataFrame, n: int | None, position: str = "src_pos") -> DataFrame:
    """The first *n* questions by file position (all of them for None)."""
    return questions if n is None else questions.orderBy(position).limit(n)


def write_jsonl(df: DataFrame, path: str | Path, mode: str = "overwrite") -> None:
    """One JSON object per line; the folder is created."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(str(path))


def count_records(spark: SparkSession, path: str | Path) -> int:
    """Number of non-blank lines."""
    return spark.read.text(str(path)).filter(~tx.is_blank(F.col("value"))).count()
