"""Delimited text: separator sniffing, tolerant load with own type inference."""

from __future__ import annotations

import csv as pycsv
import re
from functools import reduce
from urllib.parse import unquote
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.config import NA_TOKENS
from tabaudit.functions.columns import col
from tabaudit.sources.records import records, splittable

LATIN1 = "ISO-8859-1"
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"^\s*[+-]?(inf|Inf|INF|infinity|Infinity)\s*$"
_BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def first_line(spark: SparkSession, path: str | Sequence[str], encoding: str = LATIN1) -> str:
    """The header line, read without splitting it."""
    reader = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "")
    row = reader.schema("line string").csv(path).first()
    text = row["line"] if row and row["line"] is not None else ""
    return re.sub("^(\ufeff|ï»¿)", "", text)


def header_groups(spark: SparkSession, path: str | Sequence[str], encoding: str = LATIN1) -> list[list[str]]:
    """The files of a load, grouped by header line; one scan, one row per header."""
    files = spark.read.text(path).inputFiles()
    if len(files) < 2:
        return [files]
    reader = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "")
    lines = reader.schema("line string").csv(path).select(
        "line", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place")
    )
    heads = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("line", "place").alias("head"))
    found = heads.groupBy("head").agg(F.sort_array(F.collect_list("file_path")).alias("files")).orderBy("files")
    return [[unquote(f) for f in r["files"]] for r in found.collect()]


def sniff_separator(line: str) -> str:
    """Semicolon only if there is no comma, else tab if present, else comma."""
    if ";" in line and "," not in line:
        return ";"
    return "\t" if "\t" in line else ","


def header_names(line: str, sep: str) -> list[str]:
    """Column names; empty ones are ``Unnamed: i``, repeats get ``.1``, ``.2``."""
    raw = next(pycsv.reader(line.splitlines(keepends=True), delimiter=sep), [])
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(raw):
        name = name or f"Unnamed: {i}"
        base = name
        while name in out:
            seen[base] = seen.get(base, 0) + 1
            name = f"{base}.{seen[base]}"
        out.append(name)
    return out


def has_open_quotes(spark: SparkSession, path: str | Sequence[str], encoding: str = LATIN1) -> bool:
    """Does a line leave a quoted field open (a line break inside a value)?"""
    lines = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("line string").csv(path)
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1
    return bool(lines.where(odd).limit(1).count())


def read_texts(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str | None = None,
    encoding: str = LATIN1,
    multiline: bool | None = None,
) -> DataFrame:
    """All columns as text; over-long lines dropped, short ones padded with NULL.

    Every file is read by its own header: files are grouped by header line and
    the groups united by column name, a column that a group lacks being NULL.

    The schema has one column more than the header: a line that fills it has
    too many fields.  ``multiline=None`` looks for line breaks inside quotes
    first; such files are read by their records, in splits.  ``True`` reads
    every file in one task, for encodings that are not based on ASCII and for
    files whose lines end in carriage returns alone.
    """
    groups = header_groups(spark, path, encoding)
    if len(groups) > 1:
        parts = [read_texts(spark, files, sep, encoding, multiline) for files in groups]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    line = first_line(spark, path, encoding)
    sep = sep or sniff_separator(line)
    quoted = None
    if multiline is None and has_open_quotes(spark, path, encoding):
        multiline = not splittable(encoding)
        if not multiline:
            quoted = records(spark, path, sep, encoding)
            head = quoted.where("first").select("record").first()
            line = re.sub("^(\ufeff|ï»¿)", "", head["record"].rstrip("\r")) if head else line
    names = header_names(line, sep)
    if not names:
        raise ValueError(f"no header in {path}")
    inner = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*inner, "_extra", "_line"]])
    # Without pruning every line is parsed whole, so whether it fits does not
    # depend on the columns a query happens to use.
    options = {
        "columnPruning": "false", "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "nullValue": "",
    }
    if quoted is not None:
        fields = F.from_csv(F.regexp_replace("record", "\r$", ""), ", ".join(f"{f.name} string" for f in schema), options)
        raw = quoted.where(~F.col("first")).select(fields.alias("r")).select("r.*")
    else:
        raw = (
            spark.read.schema(schema).options(**options).option("header", True).option("encoding", encoding)
            .option("enforceSchema", True).option("multiLine", bool(multiline)).csv(path)
        )
    # A line with as many fields as the header is one short of the schema.
    # Separators outside quotes tell a longer line whose first surplus field is empty.
    bare = F.regexp_replace("_line", '"[^"]*"', "")
    surplus = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) > len(names) - 1
    fits = F.col("_line").isNotNull() & F.col("_extra").isNull() & ~surplus
    return raw.where(fits).select(*[F.col(i).alias(n) for i, n in zip(inner, names)])


def without_na(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Turn the usual missing-value texts into NULL."""
    return df.select(*[F.when(~col(c).isin(*tokens), col(c)).alias(c) for c in df.columns])


def _kinds(df: DataFrame) -> dict[str, str]:
    """BIGINT, DOUBLE, BOOLEAN or STRING per text column, in one pass."""
    x = F.col("value")
    long = df.unpivot([], [col(c) for c in df.columns], "column", "value")
    found = long.where(x.isNotNull()).groupBy("column").agg(
        F.min(x.rlike(_WHOLE) & F.trim(x).try_cast("bigint").isNotNull()).alias("whole"),
        F.min(x.rlike(_DECIMAL) | x.rlike(_INFINITE)).alias("decimal"),
        F.min(x.isin(*_BOOLEAN)).alias("flag"),
    )
    kind = (
        F.when(F.col("whole"), "bigint").when(F.col("decimal"), "double").when(F.col("flag"), "boolean")
        .otherwise("string")
    )
    seen = {r["column"]: r["kind"] for r in found.select("column", kind.alias("kind")).collect()}
    # A column without any value is numeric.
    return {c: seen.get(c, "double") for c in df.columns}


def _as(name: str, kind: str) -> Column:
    if kind == "string":
        return col(name)
    text = F.trim(col(name))
    if kind == "double":
        text = F.regexp_replace(text, r"(?i)^([+-]?)inf(inity)?$", "$1Infinity")
    return text.try_cast(kind).alias(name)


def infer_types(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Cast text columns to the narrowest type all their values have.

    Dates stay text.  Pass ``kinds`` to pin a schema and skip the extra pass.
    """
    kinds = kinds or _kinds(df)
    return df.select(*[_as(c, kinds[c]).alias(c) for c in df.columns])


def load(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str | None = None,
    encoding: str = LATIN1,
    heads: int | None = None,
    kinds: dict[str, str] | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """The tolerant load: sniffed separator, Latin-1, NA texts, inferred types.

    All rows are read whatever the file size; ``heads`` keeps the first n.
    """
    texts = without_na(read_texts(spark, path, sep, encoding, multiline))
    if heads is not None:
        texts = texts.limit(heads)
    return infer_types(texts, kinds)


def load_strict(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """UTF-8, comma, every line must fit the header; anything else is an error."""
    names = header_names(first_line(spark, path, "UTF-8"), ",")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (
        spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("escape", '"')
        .option("multiLine", multiline).csv(path)
    )
    return infer_types(without_na(df))
