"""Column expressions and schema helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Integer, floating and decimal columns; booleans are not numeric."""
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns with comparable values (no array, map, struct, variant)."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]


def col(name: str) -> Column:
    """Reference a column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """The column as DOUBLE with NaN treated as missing."""
    x = col(name).cast("double")
    return F.when(~F.isnan(x), x)


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell is NULL (or NaN in a floating column)."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def significance(p: Column, levels: Sequence[tuple[float, str]] = ((0.001, "***"), (0.01, "**"), (0.05, "*"))) -> Column:
    """Star code of a p-value; undefined p-values are not significant."""
    out = F.lit("ns")
    for limit, mark in reversed(list(levels)):
        out = F.when(~F.isnan(p) & (p < F.lit(limit)), F.lit(mark)).otherwise(out)
    return out


def significance_strict(p: Column) -> Column:
    """Two-level code of the findings report."""
    return significance(p, ((0.001, "***"),))


def class_text(target: Column) -> Column:
    """Class label as text; a missing class is the text ``nan``."""
    return F.coalesce(target.cast("string"), F.lit("nan"))


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; NULL if a side is constant."""
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))


def safe_name(name: Column, width: int = 31) -> Column:
    """A name usable as sheet, table or folder name."""
    return F.substring(F.regexp_replace(name, r"[:\\/?*\[\]]", "_"), 1, width)


def log_line(stamp: Column, name: Column, status: Column, reason: Column) -> Column:
    """One fixed-width audit log line."""
    return F.format_string(
        "[%s] %s | %s | %s",
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"),
        F.rpad(F.substring(name, 1, 30), 30, " "),
        F.rpad(status, 10, " "),
        reason,
    )


def rows_of(items: Sequence[Column]) -> Column:
    """Turn structs built from one wide row into rows."""
    return F.inline(F.array(*items))
