"""The descriptive profile of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import numeric_columns, string_columns
from tabaudit.operators import chartdata, profiling
from tabaudit.sources.sinks import summary_lines


def profile(df: DataFrame, curves: bool = True) -> dict[str, DataFrame]:
    """Overview, statistics, distributions, correlations, categories, outliers."""
    numbers, texts = numeric_columns(df), string_columns(df)
    out = {"overview": profiling.overview(df), "nulls": profiling.null_counts(df)}
    if numbers:
        out["statistics"] = profiling.describe(df, numbers)
        out["summary"] = summary_lines(out["statistics"])
        out["outliers"] = profiling.iqr_outliers(df, numbers)
        out["histogram"] = chartdata.histogram(df, numbers, bins=30)
        if curves:
            out["density"] = chartdata.density_curve(df, numbers, points=1000, extend=0.5)
    if len(numbers) > 1:
        out["correlation"] = profiling.correlation_matrix(df, numbers)
        out["high_correlation"] = profiling.high_correlations(df, numbers)
    if texts:
        out["categories"] = profiling.categorical_profile(df, texts)
    return out


def metadata(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """The profile as one nested row, ready for a JSON sink.

    Every list has one entry per column or column pair of the schema.
    """
    row = tables["overview"].select(F.lit(name).alias("dataset"), F.struct("*").alias("overview"))
    for key in ("statistics", "outliers", "categories", "high_correlation"):
        if key in tables:
            entry = tables[key].agg(F.sort_array(F.collect_list(F.struct("*"))).alias("v"))
            row = row.withColumn(key, entry.scalar())
    return row
