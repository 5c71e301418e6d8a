"""Label codes, one-hot features, scaling and the train/calibrate/test split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.config import AUDIT, AuditProfile
from tabaudit.functions.columns import class_text, col, number, string_columns
from tabaudit.operators.scale import running_totals, small_table, unit_hash

# Dictionaries up to this size are inlined as an expression.
INLINE_VALUES = 1_000


@dataclass(frozen=True)
class Feature:
    """One model input: its name, the column it came from, how to compute it."""

    name: str
    source: str
    value: Column


def label_dictionary(df: DataFrame, column: str, small: bool | None = None) -> DataFrame:
    """(value, code): distinct texts numbered in sorted order; missing is ``nan``."""
    values = df.select(class_text(col(column)).alias("value")).distinct().withColumn("one", F.lit(1))
    ranked = running_totals(values, "value", ["one"], small=small)
    return ranked.select("value", F.col("one_before").cast("bigint").alias("code"))


def label_encode(df: DataFrame, column: str, out: str, small: bool | None = None) -> DataFrame:
    """Add the sorted-order code of a column.

    A dictionary of up to a thousand values becomes an expression without any
    join; a longer one is joined, broadcast only if it proves small.
    """
    table, rows = small_table(label_dictionary(df, column, small))
    if rows is not None and len(rows) <= INLINE_VALUES:
        return df.withColumn(out, code_expression(col(column), sorted(r["value"] for r in rows)).cast("bigint"))
    side = table.select(F.col("value").alias("_lv"), F.col("code").alias(out))
    side = F.broadcast(side) if rows is not None else side
    return df.join(side, class_text(col(column)) == F.col("_lv"), "inner").drop("_lv")


def code_expression(column: Column, labels: Sequence[str]) -> Column:
    """Position of the text in a sorted list of labels, as DOUBLE."""
    return (F.array_position(F.array(*[F.lit(v) for v in labels]), class_text(column)) - 1).cast("double")


def target_labels(df: DataFrame, target: str, limit: int = 10_000) -> list[str]:
    """Sorted class texts of a target; a model target must have few classes."""
    rows = df.select(class_text(col(target)).alias("c")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"target {target!r} has more than {limit} classes")
    return sorted(r["c"] for r in rows)


def category_values(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of low-cardinality text columns, NULL left out."""
    if not cols:
        return {}
    long = df.select(*[col(c).alias(c) for c in cols]).unpivot([], [col(c) for c in cols], "column", "value").distinct()
    table, rows = small_table(long)
    if rows is None:
        raise ValueError("too many distinct categories to encode; drop high-cardinality columns first")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        if r["value"] is not None:
            out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def features(df: DataFrame, predictors: Sequence[str], one_hot_max: int = 10) -> list[Feature]:
    """Model inputs: numbers as they are, short text columns one-hot without the
    first category, longer ones as label codes.  Dummies follow the others."""
    texts = [c for c in string_columns(df) if c in predictors]
    values = category_values(df, texts)
    plain, dummies = [], []
    for c in predictors:
        if c not in texts:
            plain.append(Feature(c, c, F.coalesce(number(c) if not isinstance(df.schema[c].dataType, T.BooleanType)
                                                  else col(c).cast("double"), F.lit(0.0))))
        elif len(values[c]) > one_hot_max:
            # A missing value takes part in the codes as the text "nan".
            labels = sorted(set(values[c]) | {"nan"}) if has_null(df, c) else values[c]
            plain.append(Feature(c, c, code_expression(col(c), labels)))
        else:
            for v in values[c][1:]:
                dummies.append(Feature(f"{c}_{v}", c, F.coalesce((col(c) == F.lit(v)).cast("double"), F.lit(0.0))))
    return plain + dummies


def has_null(df: DataFrame, column: str) -> bool:
    return bool(df.where(col(column).isNull()).limit(1).count())


def one_hot(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Dummy columns ``<column>_<value>`` without the alphabetically first one."""
    values = category_values(df, [column])[column]
    return df.select(
        *keep, *[F.coalesce((col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values[1:]]
    )


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Subtract the mean, divide by the population deviation (1 if constant)."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(number(c)).alias(f"m{i}"), F.stddev_pop(number(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return df.withColumns(
        {c: (number(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}
    )


def split_column(keys: Sequence[str] | None, seed: int = 42) -> Column:
    """Uniform number per row: from the key hash if there is a key, else seeded."""
    return unit_hash(*keys, salt=seed) if keys else F.rand(seed)


def split_name(u: Column, split: tuple[float, float, float] = AUDIT.split) -> Column:
    train, cal, _ = split
    return F.when(u < F.lit(train), "train").when(u < F.lit(train + cal), "calibrate").otherwise("test")


def hash_split(df: DataFrame, keys: Sequence[str], split: tuple[float, float, float] = AUDIT.split, seed: int = 42) -> DataFrame:
    """Add ``part`` (train / calibrate / test), the same for any partitioning."""
    return df.withColumn("part", split_name(split_column(keys, seed), split))


def profile_features(df: DataFrame, predictors: Sequence[str], profile: AuditProfile) -> list[Feature]:
    return features(df, predictors, profile.one_hot_max)
