"""Small helpers of the training-data operators: exact lower-casing, folds, free column names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched.

    For a text of single bytes this equals ``lower``, which is far quicker than ``translate``.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def space_words(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return; null has none."""
    def at_end(cut: Callable[[Column, Column], Column]) -> Column:
        return F.coalesce(cut(text, F.lit(1)), F.lit("")).isin("", *" \t\n\x0b\f\r")

    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    # Only white space at an end leaves an empty part.
    return F.when(at_end(F.left) | at_end(F.right), F.array_remove(parts, "")).otherwise(parts)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with *value* computed once, also inside a branch that may not be taken."""
    return F.transform(F.array(value), use)[0]


def held_out(doc_id: Column) -> Column:
    """The fold kept out of training: crc32 of the id as text, modulo 5, is 0.  A null id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_names(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Column names like *wanted* that *df* does not have in any case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def small_batches(spark, rows: int = 512) -> None:
    """Hand Python at most *rows* rows at once, so that a batch of very long texts fits in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
