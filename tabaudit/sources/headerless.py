"""Headerless ``.data`` files: fields separated by commas, tabs or blanks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.sources.csv import infer_types

_SEPARATORS = r"[,\t\s]+"


def read_fields(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text columns ``0``, ``1``, ...; the longest line gives their number, shorter ones end in NULL."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parts = lines.select(F.split("value", _SEPARATORS, -1).alias("p"))
    width = parts.agg(F.max(F.size("p"))).first()[0] or 0
    return parts.select(*[F.get("p", F.lit(i)).alias(str(i)) for i in range(width)])


def drop_unknown(df: DataFrame, token: str = "?") -> DataFrame:
    """``?`` (and nothing at all) means missing; incomplete rows are left out."""
    known = df.select(*[F.when((col(c) != token) & (col(c) != ""), col(c)).alias(c) for c in df.columns])
    return known.dropna("any")


def load(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return infer_types(drop_unknown(read_fields(spark, path)))


def convert(spark: SparkSession, path: str | Sequence[str], out: str) -> None:
    """Write the cleaned rows as CSV with a header."""
    drop_unknown(read_fields(spark, path)).write.option("header", True).csv(out)
