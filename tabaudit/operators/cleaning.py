"""Healing: empty columns, imputation, complete cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col, missing, numeric_columns, string_columns
from tabaudit.operators.scale import quantile_values


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value."""
    row = df.agg(*[F.max(~missing(df, c)).alias(f"v{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if not row[f"v{i}"]]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace NULL and NaN; a fractional fill makes an integer column DOUBLE."""
    out = {}
    for name, value in values.items():
        whole = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
        kind = df.schema[name].dataType.simpleString()
        floating = kind in ("float", "double") or kind.startswith("decimal")
        keep = kind if whole or floating else "double"
        out[name] = F.when(missing(df, name), F.lit(value).cast(keep)).otherwise(col(name).cast(keep))
    return df.withColumns(out) if out else df


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, method: str = "auto") -> DataFrame:
    """Exact median, 0 where a column has no value; one number per column is collected."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    found = quantile_values(df, cols, [0.5], method=method)
    return _fill(df, {c: found.get(c, [0.0])[0] for c in cols})


def impute_text(df: DataFrame, fill: str = "Unknown", cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else string_columns(df)
    return df.na.fill(fill, cols) if cols else df


def impute_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _fill(df, {c: 0 for c in (cols if cols is not None else numeric_columns(df))})


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(cols))
