"""Text functions as Column expressions.

Everything runs in the JVM except Unicode compatibility decomposition (NFKD),
which Spark has no built-in for: only texts with a non-ASCII character are
handed, Arrow-batched, to Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values ---------------------------------------------------------
STOPWORDS = tuple(
    "a about above after all an and are as at be been before being below between both but by can "
    "could did do does during each either every for from had has have he her his how i if in into "
    "is it its may might more most my neither no nor not of on or other our out own same shall she "
    "should so some such than that the their then there these they this those through to up was we "
    "were what when where which who whom why will with would yet you your".split()
)
ABBREVIATIONS = tuple(
    "approx apr aug ave blvd corp dec dept dr e.g est etc feb fig i.e inc jan jr jul jun ltd mar mr "
    "mrs ms no nov oct pp prof sep sr st u.k u.s vol vs".split()
)
# Unicode whitespace and word characters, as a Java regex class body.
WHITESPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"
# --- end of fixed values --------------------------------------------------

_NON_ASCII = r"[^\x00-\x7F]"
# A dotted entry such as "u.s" can never be the run of letters before a boundary.
_ABBREVIATION = (
    rf"(?<!{WORD})(?i:" + "|".join(a for a in ABBREVIATIONS if "." not in a) + r")\."
)
_CLOSERS = r"""["')\]]*"""


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate *value* once per row and hand it to *use*.

    A Column used twice, or used inside a lambda, is otherwise evaluated each time.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``F.trim`` only removes spaces)."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{WHITESPACE[1:-1]}]")


def split_whitespace(text: Column) -> Column:
    """Words between Unicode whitespace; an empty array for blank text."""
    return F.array_remove(F.split(text, WHITESPACE + "+", -1), "")


def _decompose(texts: pd.Series) -> pd.Series:
    nfkd = unicodedata.normalize
    return pd.Series([None if t is None else nfkd("NFKD", t).lower() for t in texts], dtype=object)


def normalize(text: Column) -> Column:
    """NFKD, then lower case.  ASCII texts are sent to Python as nulls, so cost nothing there."""
    decompose = F.pandas_udf(_decompose, StringType())  # made per call: it belongs to one session
    return F.coalesce(decompose(F.when(text.rlike(_NON_ASCII), text)), F.lower(text))


def word_tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0))


def remove_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda token: ~token.isin(*STOPWORDS))


def _drop(token: Column, n: int) -> Column:
    return F.left(token, F.length(token) - n)


def _repair_root(root: Column) -> Column:
    """After -ing/-ed: undouble a final consonant, or restore a silent e."""
    doubled = root.rlike(r"([^aeiou])\1$")
    lone_consonant = root.rlike(r"[aeiou][^aeiou]$") & (F.length(root) >= 3)
    return (F.when(doubled, _drop(root, 1))
            .when(lone_consonant, F.concat(root, F.lit("e")))
            .otherwise(root))


def stem(token: Column) -> Column:
    """Light English suffix stripping; the first rule that applies wins."""
    def ends(suffix: str, min_root: int) -> Column:
        return token.endswith(suffix) & (F.length(token) >= min_root + len(suffix))

    return (
        F.when(F.length(token) <= 3, token)
        .when(ends("ness", 4), _drop(token, 4))
        .when(ends("tion", 3) | ends("sion", 3), _drop(token, 4))
        .when(ends("ing", 3), _repair_root(_drop(token, 3)))
        .when(ends("ed", 3), _repair_root(_drop(token, 2)))
        .when(ends("er", 3) | ends("ly", 3), _drop(token, 2))
        .when(ends("ies", 3), F.concat(_drop(token, 3), F.lit("y")))
        .when(ends("es", 3) & token.rlike(r"(?:[sxz]|ch|sh)es$"), _drop(token, 2))
        .when(ends("s", 4) & ~token.endswith("ss"), _drop(token, 1))
        .otherwise(token)
    )


def tokenize(text: Column, remove_stops: bool = True, stemmed: bool = False) -> Column:
    """Index tokens: normalise, split into words, drop stopwords, optionally stem."""
    tokens = word_tokens(normalize(text))
    if remove_stops:
        tokens = remove_stopwords(tokens)
    return F.transform(tokens, stem) if stemmed else tokens


def _non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda part: part != "")


def chunk_sentences(text: Column) -> Column:
    """Sentences for windowing: boundary = terminator, closers, space, capital letter.

    Closers after a terminator are dropped.  A boundary behind a known abbreviation
    is undone first by rewriting it to one space, so no fold over pieces is needed.
    """
    body = strip(text)
    body = F.regexp_replace(body, rf"(?<=[.!?]){_CLOSERS}{WHITESPACE}*$", "")
    body = F.regexp_replace(body, rf"({_ABBREVIATION}){_CLOSERS}{WHITESPACE}+(?=[A-Z])", "$1 ")
    boundary = rf"(?<=[.!?])(?<!{_ABBREVIATION}){_CLOSERS}{WHITESPACE}+(?=[A-Z])"
    return _non_empty(F.split(body, boundary, -1))


def answer_sentences(text: Column) -> Column:
    """Sentences for answering: any space after a terminator, bar dotted pairs and 'Xx.'."""
    boundary = (rf"(?<!{WORD}\.{WORD}[^\n])(?<![A-Z][a-z]\.)(?<=\.|\?|!){WHITESPACE}+")
    return _non_empty(F.transform(F.split(strip(text), boundary, -1), strip))


def overlap_tokens(text: Column) -> Column:
    """Lower-cased words without decomposition or stopword removal (set comparisons)."""
    return word_tokens(F.lower(text))


def jaccard(left: Column, right: Column) -> Column:
    """|intersection| / |union| of two token arrays; 0 when both are empty."""
    def share(pair: Column) -> Column:
        union = F.size(F.array_union(pair["left"], pair["right"]))
        both = F.size(F.array_intersect(pair["left"], pair["right"]))
        return F.coalesce(F.try_divide(both, union), F.lit(0.0))

    return bind(F.struct(left.alias("left"), right.alias("right")), share)


def snippet(text: Column, width: int = 120, ellipsis: bool = True) -> Column:
    """One-line preview of the first *width* characters."""
    head = F.replace(F.substring(text, 1, width), F.lit("\n"), F.lit(" "))
    if not ellipsis:
        return head
    return F.concat(head, F.when(F.length(text) > width, F.lit("…")).otherwise(F.lit("")))


def content_id(text: Column) -> Column:
    """Document id from content: first 12 hex digits of SHA-1 over the UTF-8 bytes."""
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 12)
