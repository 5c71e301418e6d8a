"""File discovery and the artefact index; file contents are never read."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.config import CHART_PREFIXES, CHART_SUFFIXES, DATA_SUFFIXES
from tabaudit.functions.columns import safe_name
from tabaudit.sources import csv, headerless


def inventory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, filename, suffix, length) of every file below ``root``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
        .select("path", "length")
    )
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.coalesce(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1), F.lit(""))
    return files.select("path", name.alias("filename"), F.lower(suffix).alias("suffix"), "length")


def data_files(
    files: DataFrame, suffixes: Sequence[str] = DATA_SUFFIXES, skip: str | None = None
) -> DataFrame:
    """Files with a data suffix; ``skip`` leaves out names containing a text."""
    out = files.where(F.col("suffix").isin(*suffixes))
    return out.where(~F.col("filename").contains(skip)) if skip else out


def audit_inputs(files: DataFrame) -> DataFrame:
    """CSV files that are not results of an earlier fusion."""
    return data_files(files, (".csv",), skip="FUSED")


def artifact_index(files: DataFrame, root: str) -> DataFrame:
    """(source_root, relative_path, filename, full_path) of every artefact."""
    clean = root.rstrip("/")
    # Listed paths carry a scheme; cut everything up to the root folder.
    relative = F.substring_index(F.col("path"), clean + "/", -1)
    top = F.when(F.contains(relative, F.lit("/")), F.split_part(relative, F.lit("/"), F.lit(1))).otherwise(F.lit(""))
    return files.select(
        top.alias("source_root"), relative.alias("relative_path"), "filename", F.col("path").alias("full_path")
    )


def chart_index(files: DataFrame, root: str) -> DataFrame:
    """Chart images by name prefix, with size in KB and a usable sheet name."""
    starts = F.lit(False)
    for p in CHART_PREFIXES:
        starts = starts | F.lower("filename").startswith(p)
    charts = files.where(F.col("suffix").isin(*CHART_SUFFIXES) & starts)
    stem = F.regexp_extract("filename", r"^(.+)\.[^.]+$", 1)
    return charts.select(
        F.col("filename").alias("chart_name"), F.upper("suffix").alias("type"),
        F.round(F.col("length") / 1024, 1).alias("size_kb"),
        F.substring_index(F.col("path"), root.rstrip("/") + "/", -1).alias("relative_path"),
        safe_name(stem).alias("sheet_tab"),
    )


def metadata_files(files: DataFrame, names: str = r"^(stats_summary\.(txt|csv)|(.*_)?metadata\.json|.*SUMMARY_REPORT\.txt|MANIFEST\.txt)$") -> DataFrame:
    return files.where(F.col("filename").rlike(names))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Read one data file or folder by its suffix."""
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".json":
        return spark.read.json(path)
    if suffix == ".data":
        return headerless.load(spark, path)
    if suffix in (".csv", ".tsv", ".txt"):
        return csv.load(spark, path)
    raise ValueError(f"no reader for {suffix or path!r}")
