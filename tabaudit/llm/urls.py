"""URL filter: expressions of host suffix and path prefix, matched by hash.

A URL is expanded into every host suffix with every path prefix that ends in a
slash, as far as the rules' own depth reaches.  Expressions meet the rules by
four bytes of SHA-256; the full digest of the rule-long expression then
confirms, and the longest confirmed rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.llm.common import ascii_lower, broadcast_if_small

# (verdict, host, path) of the production rules: fixed values.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as (verdict, host, path); paths start with a slash."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://``, A-Z lowered; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return (
        ascii_lower(F.regexp_extract(text, r"://([^/?#]*)", 1)),
        F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1),
    )


def _directory(path: Column) -> Column:
    """The path up to and including its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path.  The longest fitting rule wins (host and path together, then
    the longer host; of equal expressions ``block``).  No fitting rule gives a
    null rule and the default verdict; so do a null or empty URL and one
    without ``://``.  Hosts of rules are lower case; null rules are ignored.
    Repeated pages and repeated rules change nothing; an empty rule table
    leaves every page to the default.  Each distinct address is expanded
    once, however many pages share it.
    """
    rules = rules.dropna(subset=["verdict", "host", "path"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    parts = rules.select(
        "*",
        F.concat("host", "path").alias("rule"),
        _digest(F.col("host"), F.col("path")).alias("digest"),
        _digest(F.col("host"), _directory(F.col("path"))).substr(1, 8).alias("short"),
        F.size(F.split("host", r"\.")).alias("labels"),
        (F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("slashes"),
    )
    # Two numbers tell how deep expansions need to go.
    labels, slashes = parts.agg(F.max("labels"), F.max("slashes")).first()
    host, path = split_url(F.col(url))
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.withColumns({"host": host, "path": path})
    if labels is None:
        return split.select(*columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    names = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))),
        lambda n: F.array_join(F.slice(names, -n, n), "."),
    )
    segments = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments) - 1, F.lit(slashes))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), n), "/"), F.lit("/"))),
    )
    addresses = split.select("host", "path").filter("host != ''").distinct()
    expressions = addresses.select("host", "path", F.explode(suffixes).alias("_suffix"), F.lit(0).alias("_")).select(
        "host", "path", "_suffix", F.explode(prefixes).alias("_prefix")
    ).select("host", "path", "_suffix", _digest(F.col("_suffix"), F.col("_prefix")).substr(1, 8).alias("short"))
    sides = broadcast_if_small(parts.select("short", "digest", "rule", "verdict", F.col("host").alias("_host"), F.length("path").alias("_cut")))
    fitting = expressions.join(sides, "short").filter(
        _digest(F.col("_suffix"), F.col("path").substr(F.lit(1), F.col("_cut"))) == F.col("digest")
    )
    best = fitting.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("size"), F.length("_host").alias("of_host"), "rule", "verdict")).alias("_best")
    ).select("host", "path", "_best.rule", "_best.verdict")
    return split.select(*columns, "host", "path").join(best, ["host", "path"], "left").select(
        *columns, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


ORACLE = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT p.host, p.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
    ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY p.host, p.path)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path"""
