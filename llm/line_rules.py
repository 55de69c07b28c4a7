"""Line-first cleaning: judge every line, remove the failures, reject documents losing too much.

Everything runs inside the row, on columns; nothing is shuffled.

Line rules (the first that applies names the failure):

* ``navigation``   three or more separators ``|``
* ``symbols``      more symbol characters ``# * $ % & | < >`` than a tenth of its word characters
* ``shouting``     three words or more, letters but no lower-case one, or ``!!`` after every second word
* ``boilerplate``  licence, cookie, copyright, script and sign-in notices of up to twenty words
* ``unpunctuated`` no closing mark at its end, unless its last word is Thai or Lao, which have none

Lines without a word are dropped without counting.  A document is rejected when its base
measures fail, or when the failed lines hold more than ``max_lost`` of its word
characters.  Every failed line counts in full, whatever its rule, so ``lost_share`` is the share
of the text that is missing from ``clean_text``.

A null or empty text has no words, fails the base rule and is not kept.  Repeated rows are
each judged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import bind, space_words

SYMBOLS = r"[#*$%&|<>]"
CLOSING = [".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]",
           # Full stops, question marks and closing quotes of other scripts.
           "。", "．", "｡", "！", "？", "：", "；", "」", "』", "）", "】", "》", "〉", "“", "‘", "«", "›", "‹", "।", "॥", "۔", "؟", "؛", "։",
           "።", "፧", "။", "។", "᠃", "܀", "།"]
#: Scripts that end sentences without a mark.
UNMARKED = r"[\p{IsThai}\p{IsLao}]"
NOTICES = (
    "released under the", "licensed under", "all rights reserved", "copyright ©", "copyright (c)", "privacy policy",
    "terms of use", "terms of service", "cookie policy", "cookie settings", "uses cookies", "enable javascript",
    "javascript is", "lorem ipsum", "sign in to", "log in to", "subscribe to our", "click here")
NOTICE_WORDS = 20
MAX_LOST = 0.3
MIN_WORDS = 50
#: What a character of an unpunctuated line counts towards the loss: as much as any other; the SQL reads it here.
UNPUNCTUATED_WEIGHT = 1.0


def repeated_window_words(words: Column, mask: Column, size: int = 3) -> Column:
    """How many words lie in windows of *size* words that occur twice or more among *words*.

    Each window becomes one long: its hash in the high bits, its place in the low bits that
    *mask* leaves free (see :func:`place_mask`).  Sorted, equal windows are neighbours;
    neighbours of one hash are compared word by word, so the count is exact.
    """
    def place(key: Column) -> Column:
        return key.bitwiseAND(F.bitwise_not(mask)).cast("int")

    def places(keys: Column) -> Column:
        def same_words(i: Column) -> Column:
            a, b = place(F.get(keys, i)), place(F.get(keys, i + 1))
            equal = F.get(words, a) == F.get(words, b)
            for k in range(1, size):
                equal = equal & (F.get(words, a + k) == F.get(words, b + k))
            return equal

        order = F.when(F.size(keys) > 1, F.sequence(F.lit(0), F.size(keys) - 2)).otherwise(F.array().cast("array<int>"))
        near = F.filter(order, lambda i: F.get(keys, i).bitwiseXOR(F.get(keys, i + 1)).bitwiseAND(mask) == 0)
        pairs = F.transform(F.filter(near, same_words), lambda i: F.array(
            place(F.get(keys, i)), place(F.get(keys, i + 1))))
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    def union(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, i: F.least(
            F.coalesce(F.get(starts, i + 1) - s, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    keys = F.transform(F.slice(words, 1, F.greatest(F.size(words) - size + 1, F.lit(0))), lambda w, i: F.xxhash64(
        w, *(F.get(words, i + k) for k in range(1, size))).bitwiseAND(mask).bitwiseOR(i.cast("long")))
    return bind(bind(F.sort_array(keys), places), union)


def place_mask(n_words: Column) -> Column:
    """Ones but for as many low bits as places of *n_words* words need."""
    return F.call_function("shiftleft", F.lit(-1).cast("long"), F.ceil(F.log2(n_words + 1)).cast("int"))


def line_failure(line: Column, words: Column, chars: Column, symbols: Column) -> Column:
    """The rule that *line* breaks, or null."""
    n = F.size(words)
    return (F.when((symbols >= 3) & (F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit(""))) >= 3),
                   "navigation")
            .when(symbols * 10 > chars, "symbols")
            .when((n >= 3) & ((~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
                              | (F.char_length(line) - F.char_length(F.replace(line, F.lit("!!"), F.lit(""))) > n)),
                  "shouting")
            .when((n <= NOTICE_WORDS) & bind(F.lower(line), _any_notice), "boilerplate")
            .when(~F.right(F.element_at(words, -1), F.lit(1)).isin(CLOSING) & ~F.element_at(words, -1).rlike(UNMARKED), "unpunctuated"))


def _any_notice(lowered: Column) -> Column:
    found = F.lit(False)
    for phrase in NOTICES:
        found = found | F.contains(lowered, F.lit(phrase))
    return found


def judged_line(line: Column, words: Column) -> Column:
    """line, words, chars (code points in words), symbols, failure."""
    def with_symbols(joined: Column) -> Column:
        def finish(symbols: Column) -> Column:
            chars = F.char_length(joined)
            return F.struct(line.alias("line"), words.alias("words"), chars.alias("chars"), symbols.alias("symbols"),
                            line_failure(line, words, chars, symbols).alias("failure"))

        return bind(F.char_length(joined) - F.char_length(F.regexp_replace(joined, SYMBOLS, "")), finish)

    return bind(F.array_join(words, ""), with_symbols)


def clean_documents(docs: DataFrame, max_lost: float = MAX_LOST, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of *docs* (doc_id, text): the base measures, verdicts and the text without failed lines.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, n_failed_lines, lost_share, clean_text.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    split = docs.select("doc_id", F.filter(
        F.transform(lines, lambda line: bind(space_words(line), lambda words: F.when(
            F.size(words) > 0, judged_line(line, words)))), lambda x: x.isNotNull()).alias("judged"))
    worded = split.select("doc_id", "judged", F.flatten(F.transform("judged", lambda x: x["words"])).alias("words"))
    masked = worded.select("*", place_mask(F.size("words")).alias("mask"))

    def total(field: str) -> Column:
        return F.aggregate("judged", F.lit(0).cast("long"), lambda sum_, x: sum_ + x[field])

    judged = masked.select(
        "doc_id", "judged", F.size("words").cast("long").alias("n_words"), total("chars").alias("word_chars"),
        total("symbols").alias("n_symbols"),
        (F.size("judged") - F.size(F.array_distinct(F.transform("judged", lambda x: x["line"])))).cast("long")
        .alias("n_dup_lines"),
        repeated_window_words(F.col("words"), F.col("mask")).cast("long").alias("n_repeat_words"))
    lost = F.aggregate("judged", F.lit(0.0), lambda total, x: total + F.when(x["failure"].isNull(), 0.0)
                       .otherwise(1.0) * x["chars"])
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = F.when(F.col("word_chars") > 0, lost / F.col("word_chars")).otherwise(0.0)
    passed = F.filter("judged", lambda x: x["failure"].isNull())
    return (judged.select("*", base_failed.alias("base_failed"), share.alias("lost_share"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("lost_share") <= max_lost)).alias("kept"),
                    F.size("judged").cast("long").alias("n_lines"),
                    (F.size("judged") - F.size(passed)).cast("long").alias("n_failed_lines"), "lost_share",
                    F.array_join(F.transform(passed, lambda x: x["line"]), "\n").alias("clean_text")))
