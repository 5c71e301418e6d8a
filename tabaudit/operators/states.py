"""Mergeable profile states of columns, one row per file and column.

A state holds counts, central moments, extremes, a quantile sketch and a
distinct sketch.  States of files merge to those of the table, so a new file
is read once and no other file again.  Quantile sketches bracket the exact
quantiles of a later pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.columns import col, missing, number
from tabaudit.operators.scale import SKETCH_VALUES, exact_quantiles, spread

# Registers of the distinct sketch are 2 to this power (0.8 % standard error).
HLL_BITS = 14


def _cells(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., column, x, h): every cell with its number, if it is one, and a digest, if it is present."""
    kinds = {f.name: f.dataType for f in df.schema}

    def cell(c: str) -> Column:
        plain = isinstance(kinds[c], T.AtomicType) and not isinstance(kinds[c], T.BinaryType)
        value = F.when(~missing(df, c), F.xxhash64(col(c) + F.lit(0.0) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else col(c).cast("string") if plain else F.lit(0)))
        x = number(c) if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("column"), x.alias("x"), value.alias("h"))

    used = df.select(*[col(c) for c in dict.fromkeys([*by, *cols])])
    return spread(used).select(*[col(b) for b in by], F.inline(F.array(*[cell(c) for c in cols])))


def _aggregates() -> list[Column]:
    x, n = F.col("x"), F.count("x")
    spread = F.var_pop(x)
    # Central moments from the built-in shape measures; a column of one value has none.
    return [
        F.count(F.lit(1)).alias("rows"), F.count("h").alias("present"), n.alias("n"), F.avg(x).alias("mean"), (spread * n).alias("m2"),
        F.coalesce(F.skewness(x) * n * F.pow(spread, F.lit(1.5)), F.lit(0.0)).alias("m3"),
        F.coalesce((F.kurtosis(x) + 3.0) * n * spread * spread, F.lit(0.0)).alias("m4"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.kll_sketch_agg_double(x, F.lit(SKETCH_VALUES)).alias("sketch"), F.hll_sketch_agg("h", F.lit(HLL_BITS)).alias("distinct"),
    ]


def column_states(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, rows, present, n, mean, m2, m3, m4, min, max, sketch, distinct) in one scan.

    ``present`` counts cells with a value, ``n`` those that are numbers;
    ``m2`` to ``m4`` are sums of powers of deviations from the mean.
    """
    cols = list(cols) if cols is not None else list(df.columns)
    return _cells(df, cols, by).groupBy(*by, "column").agg(*_aggregates())


def merged_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of the union of what the given rows describe; same columns, one row per column (and group)."""
    keys = [*by, "column"]
    n = F.col("n")
    means = states.groupBy(*keys).agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("_mean"))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    both = states.alias("s").join(means.alias("m"), on).select("s.*", "_mean")
    # Moments move from each part's mean to the common one.
    d = F.col("mean") - F.col("_mean")
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    return both.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.sum("n").alias("n"), F.max("_mean").alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * F.pow(d, F.lit(4.0))).alias("m4"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_VALUES)).alias("sketch"), F.hll_union_agg("distinct").alias("distinct"),
    )


def shape_measures(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, mean, std, min, max, skewness, kurtosis, null_count) of numeric columns, as ``moments`` has it."""
    n, m2 = F.col("n"), F.col("m2")
    spread = F.when(m2 > 0, m2 / n)
    return states.where("n > 0").select(
        *by, "column", "n", "mean", F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"), "min", "max",
        (F.col("m3") / n / F.pow(spread, F.lit(1.5))).alias("skewness"), (F.col("m4") / n / (spread * spread) - 3.0).alias("kurtosis"),
        (F.col("rows") - F.col("present")).alias("null_count"),
    )


def distinct_estimates(states: DataFrame) -> DataFrame:
    """(column, distinct_estimate): about 0.8 % off (one standard deviation)."""
    return states.select("column", F.hll_sketch_estimate("distinct").alias("distinct_estimate"))


def described(df: DataFrame, cols: Sequence[str], states: DataFrame) -> DataFrame:
    """The numeric summary with exact quartiles, bracketed by the states' sketches: one more scan of ``df``."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], method="distributed", sketches=states.where("n > 0").select("column", "n", "sketch"))
    q = q.select("column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    # One row per column on both sides.
    return shape_measures(states).join(F.broadcast(q), "column").select(
        "column", "n", "mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis", "null_count"
    )


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(store) if known else None


def file_states(
    spark: SparkSession, path: str, store: str, cols: Sequence[str] | None = None, read: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """(file, column, ...): states of every file below ``path``; only files not in ``store`` yet are read.

    Their states are appended to ``store``, a Parquet folder.  Files that are
    gone from ``path`` are left out of the result but stay in the store.
    ``read`` takes paths and gives a table of files; Parquet by default.
    """
    read = read or (lambda *paths: spark.read.parquet(*paths))
    # Listed and recorded names may differ in the slashes after the scheme.
    listed = {re.sub("^([a-z0-9]+):/+", r"\1:/", f): f for f in read(path).inputFiles()}
    present = spark.createDataFrame([(f,) for f in listed], "file string")
    known = _stored(spark, store)
    fresh = present if known is None else present.join(known.select("file").distinct(), "file", "left_anti")
    new = [unquote(listed[r["file"]]) for r in fresh.collect()]
    if new:
        df = read(*new)
        named = df.select(F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/").alias("_file"), *[col(c) for c in (cols or df.columns)])
        states = column_states(named, [c for c in named.columns if c != "_file"], ["_file"]).withColumnRenamed("_file", "file")
        states.write.mode("append").parquet(store)
    return spark.read.parquet(store).join(present, "file", "left_semi")


def file_sizes(states: DataFrame) -> DataFrame:
    """(table, rows, cols, missing, cells) per file, as the missing-rate roll-up takes them, from states alone."""
    return states.groupBy(F.col("file").alias("table")).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("cols"), F.sum(F.col("rows") - F.col("present")).alias("missing"), F.sum("rows").alias("cells")
    )
