"""Table schemas.  Every operator takes and returns DataFrames of these shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

QUESTIONS = T.StructType([
    T.StructField("qid", T.StringType(), False),
    T.StructField("question", T.StringType(), False),
    T.StructField("answer", T.StringType(), False),
    T.StructField("relevant_doc_ids", T.ArrayType(T.StringType())),
])

# One row per result: rank is explicit and starts at 1 within each qid.
RUN_COLUMNS = ("qid", "rank", "chunk_id", "doc_id", "score", "retriever")

# Columns every chunk table has; chunkers add typed position columns.
CHUNK_COLUMNS = ("chunk_id", "doc_id", "text", "index")


def require_columns(df: DataFrame, names: tuple[str, ...], what: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; it has {df.columns}")
