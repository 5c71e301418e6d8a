"""Most frequent values of columns without shuffling the values themselves.

A summary of bounded size per task names every value that may be frequent;
summaries add up, and only the cells of the named values are counted exactly.
Columns without frequent values are counted by 128-bit digests of their
values, with a short prefix to settle ties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.columns import col, scalar_columns
from tabaudit.operators.scale import materialize, small_table

# A task keeps about so many counters per column.
KEPT = 4096
# Ties of digests are settled by so many first characters before whole values are looked at.
PREFIX = 32


def value_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(id, value): every cell of the numbered columns as text; NaN is NULL, -0.0 is 0.0."""
    kinds = {f.name: f.dataType for f in df.schema}

    def text(c: str) -> Column:
        x = col(c)
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            x = F.nanvl(x, F.lit(None).cast("double")) + F.lit(0.0)
        return x.cast("string")

    names = [str(i) for i in range(len(cols))]
    long = df.select(*[text(c).alias(n) for c, n in zip(cols, names)]).unpivot([], [col(n) for n in names], "id", "value")
    return long.select(F.col("id").cast("int").alias("id"), "value")


def _digest(salt: int) -> Column:
    return F.when(F.col("value").isNotNull(), F.xxhash64(F.lit(salt), "value"))


def value_digests(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(id, h, g, n, prefix): counts of every value by its 128-bit digest; missing cells have none.

    What is shuffled is a digest, a count and a prefix, whatever the length of the values.
    """
    prefix = F.substring("value", 1, PREFIX).alias("prefix")
    cells = value_cells(df, cols).select("id", _digest(0).alias("h"), _digest(1).alias("g"), prefix)
    return cells.groupBy("id", "h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("prefix").alias("prefix"))


class _Summary:
    """Counters of frequent values: what a counter misses, and what an unlisted value has, is at most ``missed``."""

    def __init__(self, kept: int):
        self.kept, self.missed, self.cells = kept, 0, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.cells += len(keys)
        new, counts = np.unique(keys, return_counts=True)
        every, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.counts, counts]), len(every)).astype(np.int64)
        if len(every) > self.kept:
            # All counters give way by the largest one that no longer has a place.
            cut = int(np.partition(total, len(total) - self.kept - 1)[len(total) - self.kept - 1])
            self.missed += cut
            every, total = every[total > cut], total[total > cut] - cut
        self.keys, self.counts = every, total


def summaries(df: DataFrame, cols: Sequence[str], kept: int = KEPT) -> DataFrame:
    """(id, h, low, missed, cells): counters of all tasks together, and per column (h null) what they may miss."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Summary] = {}
        for batch in batches:
            ids, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i in np.unique(ids).tolist():
                held.setdefault(i, _Summary(kept)).add(keys[ids == i])
        for i, s in held.items():
            n = len(s.keys)
            yield pa.RecordBatch.from_arrays([
                pa.array([i] * (n + 1), pa.int32()), pa.array([*s.keys.tolist(), None], pa.int64()), pa.array([*s.counts.tolist(), 0], pa.int64()),
                pa.array([0] * n + [s.missed], pa.int64()), pa.array([0] * n + [s.cells], pa.int64()),
            ], ["id", "h", "low", "missed", "cells"])

    hashes = value_cells(df, cols).where("value is not null").select("id", _digest(0).alias("h"))
    parts = hashes.mapInArrow(summed, "id int, h long, low long, missed long, cells long")
    return parts.groupBy("id", "h").agg(*[F.sum(c).alias(c) for c in ("low", "missed", "cells")])


def _named(df: DataFrame, cols: Sequence[str], k: int, kept: int) -> tuple[DataFrame | None, list[int]]:
    """(id, h) of all values that can be among the ``k`` most frequent, and the columns whose summary cannot tell."""
    found = materialize(summaries(df, cols, kept), "summaries")
    # One row per column.
    facts = {r["id"]: (r["cells"], r["missed"]) for r in found.where("h is null").collect()}
    if not facts:
        return None, []
    lit = lambda of: F.create_map(*[F.lit(x) for i in facts for x in (i, of(i))])[F.col("id")]
    # Values with more than 2 / kept of the cells: fewer than half as many as counters, per column.
    high = found.where(F.col("h").isNotNull() & (F.col("low") * kept > lit(lambda i: 2 * facts[i][0])))
    counts: dict[int, list[int]] = {}
    for r in high.select("id", "low").collect():
        counts.setdefault(r["id"], []).append(r["low"])
    told = {i: sorted(c)[-k] for i, c in counts.items() if len(c) >= k}
    unclear = [i for i in facts if i not in told]
    if not told:
        return None, unclear
    # A value of the k most frequent has at least the k-th count; its counter misses ``missed`` of it at most.
    least = F.create_map(*[F.lit(x) for i, low in told.items() for x in (i, low - facts[i][1])])[F.col("id")]
    return found.where(F.col("h").isNotNull() & (F.col("low") >= least)).select("id", "h"), unclear


def _first_digests(digests: DataFrame, ids: Sequence[int], k: int) -> DataFrame | None:
    """(id, h) of the ``k`` most frequent values of some columns, and of all that tie with the last up to the prefix."""
    out = None
    for i in ids:
        own = digests.where((F.col("id") == i) & F.col("h").isNotNull())
        # k rows.
        first = own.orderBy(F.desc("n"), "prefix").limit(k).select("n", "prefix").collect()
        if first:
            n, prefix = first[-1]
            some = own.where((F.col("n") > n) | ((F.col("n") == n) & (F.col("prefix") <= F.lit(prefix)))).select("id", "h")
            out = some if out is None else out.unionByName(some)
    return out


def _counted(df: DataFrame, cols: Sequence[str], named: DataFrame, k: int) -> DataFrame:
    """The cells of the named values counted exactly: (column, value, n, place)."""
    side, rows = small_table(named.distinct())
    cells = value_cells(df, cols).where("value is not null").withColumn("h", _digest(0))
    counts = cells.join(F.broadcast(side) if rows is not None else side, ["id", "h"], "left_semi").groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "value"))
    name = F.array(*[F.lit(c) for c in cols])[F.col("id")]
    return counts.withColumn("place", place).where(F.col("place") <= k).select(name.alias("column"), "value", "n", "place")


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10, kept: int = KEPT) -> DataFrame:
    """The ``k`` most frequent present values of each column: (column, value, n, place).

    Counts are exact; ties go to the smaller value.  A column whose k-th
    value is too rare for the summaries is counted by digests.
    """
    cols = list(cols) if cols is not None else scalar_columns(df)
    empty = df.sparkSession.createDataFrame([], "column string, value string, n bigint, place int")
    if not cols or k < 1:
        return empty
    named, unclear = _named(df, cols, k, kept)
    if unclear:
        rest = [cols[i] for i in unclear]
        digests = materialize(value_digests(df, rest), "digests")
        first = _first_digests(digests, range(len(rest)), k)
        if first is not None:
            back = F.array(*[F.lit(i) for i in unclear])[F.col("id")].alias("id")
            first = first.select(back, "h")
            named = first if named is None else named.unionByName(first)
    return empty if named is None else _counted(df, cols, named, k)


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, unique_values, most_common, most_common_count, null_count) from digests; values of the modes alone are read."""
    digests = materialize(value_digests(df, cols), "digests")
    name = F.array(*[F.lit(c) for c in cols])[F.col("id")]
    sizes = digests.groupBy("id").agg(
        F.count("h").alias("unique_values"), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("null_count")
    ).select(name.alias("column"), "unique_values", "null_count")
    named = _first_digests(digests, range(len(cols)), 1)
    if named is None:
        modes = df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    else:
        modes = _counted(df, cols, named, 1).select("column", "value", "n")
    return sizes.join(F.broadcast(modes), "column", "left").select(
        "column", "unique_values", F.col("value").alias("most_common"), F.coalesce("n", F.lit(0)).alias("most_common_count"), "null_count"
    )
