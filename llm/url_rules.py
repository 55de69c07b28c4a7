"""URL filtering by pattern rules that are indexed by their rarest literal token.

A URL is read as a *host* (after the first ``://``, up to ``/ ? #`` or the end, A-Z
lower-cased) and a *path* (what follows, up to ``?``, ``#`` or the end).  Rules come in
two kinds:

* **host rules** name a host and a path prefix.  They fit the host and all its
  subdomains; of several that fit, the longest decides.
* **pattern rules** are matched against host + path: ``*`` stands for any characters,
  ``^`` for an end or anything but a letter, digit or underscore.  They decide where no
  host rule fits, and an allowing pattern beats a blocking one.

Each rule becomes one regular expression and a list of literal tokens that every URL it
matches must contain as whole tokens.  The token that the fewest URLs contain is the
rule's index key.  URL tokens fetch candidate rules by an equi-join on that key, and only
those candidates are run.  A rule without such a token is indexed under the empty token,
which every URL carries, so it is always run.

Nulls and URLs without ``://`` have an empty host and path, which host rules never fit.
Repeated rows are each judged.  An empty table gives an empty result; an empty rule list
gives the default verdict.  Rules with null host and path and null pattern are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import ascii_lower
from rankloom.runtime import broadcast_if_small

RULE_SCHEMA = "verdict string, host string, path string, pattern string"
TOKEN = "[a-z0-9]+"
#: Rules that may be sent to every executor; some 300 bytes each.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, host_rules: Sequence[tuple[str, str, str]],
                pattern_rules: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rules from lists of (verdict, host, path) and (verdict, pattern)."""
    rows = [(v, h, p, None) for v, h, p in host_rules] + [(v, None, None, p) for v, p in pattern_rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _quoted(literal: Column) -> Column:
    return F.regexp_replace(literal, r"([^\p{L}\p{N}_])", r"\\$1")


def compile_rules(rules: DataFrame) -> DataFrame:
    """rule, verdict, is_host, regex, tokens (whole tokens of every URL that the rule matches)."""
    host, path, pattern = ascii_lower(F.col("host")), F.coalesce("path", F.lit("")), F.col("pattern")
    is_host = pattern.isNull()
    host_regex = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _quoted(host),
                          F.when(path == "", F.lit("(?:/.*)?$")).otherwise(F.concat(_quoted(path), F.lit(".*$"))))
    parts = F.transform(F.split(pattern, r"\*", -1), lambda part: F.array_join(
        F.transform(F.split(part, r"\^", -1), _quoted), "(?:[^A-Za-z0-9_]|^|$)"))
    pattern_regex = F.concat(F.lit("(?s)"), F.array_join(parts, ".*"))
    # A token counts only when it cannot be cut short or go on: a path prefix may end inside one.
    host_text = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))
    host_tokens = F.regexp_extract_all(ascii_lower(host_text), F.lit(f"({TOKEN})(?=[^a-z0-9])"), 1)
    pattern_tokens = F.regexp_extract_all(
        ascii_lower(pattern), F.lit(rf"(?<=[^a-z0-9*])({TOKEN})(?=[^a-z0-9*])"), 1)
    return (rules.where(F.col("host").isNotNull() | pattern.isNotNull())
            .select(F.when(is_host, F.concat(F.coalesce("host", F.lit("")), path)).otherwise(pattern).alias("rule"),
                    "verdict", is_host.alias("is_host"),
                    F.when(is_host, host_regex).otherwise(pattern_regex).alias("regex"),
                    F.when(is_host, host_tokens).otherwise(pattern_tokens).alias("tokens"))
            .distinct())


def url_tokens(text: Column) -> Column:
    """The distinct tokens of a URL and the empty one."""
    tokens = F.regexp_extract_all(ascii_lower(text), F.lit(f"({TOKEN})"), 1)
    return F.array_distinct(F.concat(F.array(F.lit("")), tokens))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """*rules* with their index key: the token that the fewest of *urls* (host, path) contain."""
    each = rules.select("rule", "regex", F.explode("tokens").alias("token"))
    asked = broadcast_if_small(each.select("token").distinct(), BROADCAST_RULES)
    seen = (urls.select(F.explode(url_tokens(F.concat("host", "path"))).alias("token"))
            .join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")))
    key = (each.join(seen, "token", "left").groupBy("rule", "regex")
           .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("best"))
           .select("rule", "regex", F.col("best.token").alias("key")))
    return (rules.join(key, ["rule", "regex"], "left")
            .select("rule", "verdict", "is_host", "regex", F.coalesce("key", F.lit("")).alias("key")))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row's url.  Returns page_id, host, path, rule, verdict, pattern.

    *rule* is the host rule that decided, *pattern* the pattern rule, both null where the
    default verdict holds.  Only distinct (host, path) pairs meet the rules; a pair that
    fits none is not shuffled again, and rows fetch their verdict by an outer join that
    adaptive execution splits where one URL has very many rows.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = rows.select("host", "path").distinct()
    index = broadcast_if_small(index_rules(compile_rules(rules), urls), BROADCAST_RULES)
    text = F.concat("host", "path")
    fits = (urls.select("host", "path", F.explode(url_tokens(text)).alias("key"))
            .join(index, "key").where(F.expr("concat(host, path) RLIKE regex")))
    # Host rules first, then the longest text, then allow before block, then the text itself.
    order = F.struct(
        F.col("is_host").alias("is_host"),
        F.when(F.col("is_host"), F.char_length("rule")).otherwise(0).alias("length"),
        (F.col("verdict") == "allow").alias("allow"), F.col("rule").alias("rule"),
        F.col("verdict").alias("verdict"))
    decided = fits.groupBy("host", "path").agg(F.max(order).alias("best"))
    return (rows.join(decided, ["host", "path"], "left")
            .select("page_id", "host", "path",
                    F.when(F.col("best.is_host"), F.col("best.rule")).alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
                    F.when(~F.col("best.is_host"), F.col("best.rule")).alias("pattern")))
