"""Rule-based text scan: every match of every rule with its line number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.config import SOURCE_TEXT_RULES, TextRule
from tabaudit.functions.columns import col
from tabaudit.operators.scale import spread


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def scan(df: DataFrame, key: str, text: str, rules: Sequence[TextRule] = SOURCE_TEXT_RULES) -> DataFrame:
    """(key, rule, severity, match_no, line, code): one row per match.

    The text between matches tells how many lines lie before each of them, so
    matches may span lines.  Only line counts and the first 50 characters of
    a match leave the scan.
    """
    body = col(text)
    found = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
            F.split(body, r.pattern, -1).alias("between"),
            F.regexp_extract_all(body, F.lit(r.pattern), F.lit(0)).alias("hits"),
        )
        for r in rules
    ]
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | body.rlike(r.pattern)
    per_rule = spread(df.select(key, text)).where(any_rule).select(col(key).alias(key), F.inline(F.array(*found))).where(F.size("hits") > 0)
    # Lines before each match, counted inside the text: no grouping, whatever the key.  Steps are added up by blocks
    # of about the root of their number and blocks among themselves, so many matches in one text do not cost their square.
    step = lambda pair: _newlines(pair["between"]) + _newlines(F.coalesce(pair["hits"], F.lit("")))
    added = lambda steps: F.aggregate(steps, F.lit(0), lambda n, x: n + x)
    size = F.col("_size")
    blocks = per_rule.select(
        "*", F.transform(F.slice(F.arrays_zip("hits", "between"), F.lit(1), F.size("hits")), step).alias("_steps"),
        F.ceil(F.sqrt(F.size("hits"))).cast("int").alias("_size"),
    ).withColumn("_blocks", F.transform(F.sequence(F.lit(1), F.size("_steps"), size), lambda i: added(F.slice("_steps", i, size))))
    counted = blocks.withColumn("_starts", F.transform(F.sequence(F.lit(0), F.size("_blocks") - 1), lambda i: added(F.slice("_blocks", F.lit(1), i))))
    block = lambda i: (i / size).cast("int")
    before = F.transform(
        F.sequence(F.lit(0), F.size("hits") - 1),
        lambda i: F.get("_starts", block(i)) + added(F.slice("_steps", block(i) * size + 1, i % size)) + _newlines(F.get("between", i)) + F.lit(1),
    )
    matches = counted.select(
        key, "rule", "severity", F.posexplode(F.arrays_zip("hits", before.alias("line"))).alias("match_no", "m")
    )
    return matches.select(
        key, "rule", "severity", "match_no", F.col("m.line").cast("bigint").alias("line"), F.substring("m.hits", 1, 50).alias("code")
    )


def totals(df: DataFrame, key: str, text: str, rules: Sequence[TextRule] = SOURCE_TEXT_RULES) -> DataFrame:
    """(key, severity, matches): counted inside each text, nothing is exploded."""
    body = col(text)
    parts = [
        F.struct(F.lit(r.severity).alias("severity"), F.regexp_count(body, F.lit(r.pattern)).alias("n")) for r in rules
    ]
    return (
        spread(df.select(key, text)).select(col(key).alias(key), F.inline(F.array(*parts))).where("n > 0")
        .groupBy(key, "severity").agg(F.sum("n").cast("bigint").alias("matches"))
    )


def first_matches(matches: DataFrame, key: str, rules: Sequence[TextRule] = SOURCE_TEXT_RULES, k: int = 5) -> DataFrame:
    """The first k matches of every text, in rule order."""
    place = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule"))
    w = Window.partitionBy(key).orderBy(place, "match_no")
    return matches.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def rule_table(spark, rules: Sequence[TextRule] = SOURCE_TEXT_RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.pattern, r.severity, r.description, r.fix) for r in rules],
        "rule string, pattern string, severity string, description string, fix string",
    )
