"""Descriptive profile: shape, nulls, duplicates, moments, distincts, correlation, outliers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.columns import (
    col, missing, number, numeric_columns, pearson, percent, rows_of, scalar_columns, string_columns,
)
from tabaudit.operators import frequent, states
from tabaudit.operators.scale import DIRECT_BYTES, exact_quantiles, is_small, materialize

# Pairwise correlation as plain aggregates up to this many columns; beyond it
# tiles of Gram matrices are summed: so many columns to a side, so many bytes in a task.
PAIRWISE_COLUMNS = 3
BLOCK_COLUMNS = 256
HELD_BYTES = 64 * 1024 * 1024


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
        "total_columns", F.lit(len(df.columns)).cast("bigint")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """(column, total, nulls, null_pct), all columns in one pass."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(missing(df, c)).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    items = [
        F.struct(F.lit(c).alias("column"), F.col("_rows").alias("total"), F.col(f"_n{i}").alias("nulls"))
        for i, c in enumerate(df.columns)
    ]
    return wide.select(rows_of(items)).withColumn("null_pct", percent(F.col("nulls"), F.col("total")))


def null_totals(df: DataFrame) -> DataFrame:
    """Missing cells over the whole table."""
    return null_counts(df).agg(
        F.max("total").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("nulls").alias("null_cells"),
        percent(F.sum("nulls"), F.sum("total")).alias("null_percentage"),
    )


def duplicate_rows(df: DataFrame, method: str = "auto") -> DataFrame:
    """Rows minus distinct rows; NULL equals NULL.

    ``'direct'`` groups whole rows: one shuffle, copies combined before it.
    ``'hashed'`` (large tables) first counts 8-byte row hashes; a hash seen
    once is a distinct row, and only rows sharing a hash are compared whole.
    """
    if method == "auto":
        method = "direct" if is_small(df) else "hashed"
    cols = [col(c) for c in df.columns]
    if method == "direct":
        groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        counts = groups.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows")
        )
    else:
        row_hash = F.xxhash64(*cols).alias("_h")
        hashes = materialize(df.select(row_hash).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")), "hashes")
        shared = hashes.where("_n > 1").select("_h")
        once = hashes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count_if(F.col("_n") == 1).alias("_once"))
        whole = df.select("*", row_hash).join(shared, "_h", "left_semi").select(*cols).distinct()
        several = whole.agg(F.count(F.lit(1)).alias("_several"))
        counts = once.select("total_rows", (F.col("_once") + several.scalar()).alias("distinct_rows"))
    return counts.withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicates, missing cells and their share."""
    nulls = null_totals(df).withColumn("_k", F.lit(len(df.columns)))
    dups = duplicate_rows(df).select(F.lit(len(df.columns)).alias("_k2"), "duplicate_rows")
    return nulls.join(F.broadcast(dups), F.col("_k") == F.col("_k2")).drop("_k", "_k2")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, max, skewness, excess kurtosis per column; one pass.

    Columns become rows before aggregating: one set of aggregates stays small
    enough to be compiled well, whatever the number of columns.
    """
    long = df.select(*[number(c).alias(c) for c in cols]).unpivot([], [col(c) for c in cols], "column", "value")
    x = F.col("value")
    stats = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
    )
    return stats.where("n > 0").withColumn("null_count", F.col("_rows") - F.col("n")).drop("_rows")


def describe(df: DataFrame, cols: Sequence[str] | None = None, method: str = "auto") -> DataFrame:
    """Numeric summary with exact quartiles; columns without values are left out.

    ``'direct'`` is for small tables; ``'distributed'`` scans the table twice.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if method == "auto":
        method = "direct" if is_small(df.select(*[col(c) for c in cols]), DIRECT_BYTES) else "distributed"
    if method == "distributed" and cols:
        # Two scans: all states with sketches, then the values inside the brackets.
        return states.described(df, cols, materialize(states.column_states(df, cols), "states"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], method=method).select(
        "column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")
    )
    # One row per column on both sides.
    return moments(df, cols).join(F.broadcast(q), "column").select(
        "column", "n", "mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis", "null_count"
    )


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) for all given columns in one pass; NULL and NaN are NULL, -0.0 is 0.0."""
    cols = list(cols) if cols is not None else scalar_columns(df)
    kinds = {f.name: f.dataType for f in df.schema}
    text = lambda c: (F.nanvl(col(c), F.lit(None).cast("double")) + F.lit(0.0) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else col(c)).cast("string")
    long = df.select(*[text(c).alias(c) for c in cols]).unpivot([], [col(c) for c in cols], "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, distinct_count) without NULLs.

    The exact form groups (column, value) pairs; `count(distinct)` of many
    columns at once would multiply every row instead.  Values of large tables
    are told apart by 128-bit digests.
    """
    cols = list(cols) if cols is not None else scalar_columns(df)
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
        items = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_count")) for i, c in enumerate(cols)]
        return wide.select(rows_of(items))
    return distinct_and_rows(df, cols).select("column", "distinct_count")


def distinct_and_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, distinct_count, rows); values of large tables are told apart by 128-bit digests, so none is shuffled."""
    if is_small(df.select(*[col(c) for c in cols])):
        return value_counts(df, cols).groupBy("column").agg(F.count("value").alias("distinct_count"), F.sum("n").alias("rows"))
    name = F.array(*[F.lit(c) for c in cols])[F.col("id")]
    counts = frequent.value_digests(df, cols).groupBy("id").agg(F.count("h").alias("distinct_count"), F.sum("n").alias("rows"))
    return counts.select(name.alias("column"), "distinct_count", "rows")


def small_distinct_counts(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, int]:
    """Exact distinct counts up to ``limit``; larger columns report an estimate.

    Rules only ask whether a column has more than a few dozen values, so only
    columns whose sketch is near the limit are counted exactly.
    """
    cols = list(cols)
    if not cols:
        return {}
    if is_small(df.select(*[col(c) for c in cols])):
        return {r["column"]: r["distinct_count"] for r in distinct_counts(df, cols).collect()}
    found = {r["column"]: r["distinct_count"] for r in distinct_counts(df, cols, approximate=True).collect()}
    near = [c for c in cols if found[c] <= 2 * limit + 20]
    if near:
        found.update({r["column"]: r["distinct_count"] for r in distinct_counts(df, near).collect()})
    return found


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None, method: str = "auto") -> DataFrame:
    """Distinct values, most common value and missing cells per string column.

    Ties for most common go to the smallest value.  ``'direct'`` groups the
    values themselves, ``'digested'`` (large tables) their digests.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    if method == "auto":
        method = "direct" if is_small(df.select(*[col(c) for c in cols])) else "digested"
    if method == "digested" and cols:
        return frequent.categorical_profile(df, cols)
    counts = value_counts(df, cols)
    # Largest count first, then smallest value: min of (-n, value).
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))))
    return (
        counts.groupBy("column")
        .agg(
            F.count("value").alias("unique_values"),
            best.alias("_b"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        )
        .select(
            "column", "unique_values", F.col("_b.v").alias("most_common"),
            F.coalesce(-F.col("_b.k"), F.lit(0)).alias("most_common_count"), "null_count",
        )
    )


# ----------------------------------------------------------------- correlation


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, block: int = BLOCK_COLUMNS, held: int = HELD_BYTES) -> DataFrame:
    """(var1, var2, n, r) for var1 before var2, over rows where both are present.

    Wide tables are summed in tiles of ``block`` by ``block`` columns; a task
    holds tiles of at most about ``held`` bytes, and more tiles take further
    scans of their columns alone.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, n bigint, r double")
    if len(cols) <= PAIRWISE_COLUMNS:
        return _pairs_as_aggregates(df, cols)
    return _pairs_by_tiles(df, cols, block, held)


def _pairs_as_aggregates(df, cols):
    aggs, items = [], []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            x, y = number(cols[i]), number(cols[j])
            aggs += [F.count(F.when(x.isNotNull(), y)).alias(f"n_{i}_{j}"), pearson(x, y).alias(f"r_{i}_{j}")]
            items.append(
                F.struct(
                    F.lit(cols[i]).alias("var1"), F.lit(cols[j]).alias("var2"),
                    F.col(f"n_{i}_{j}").alias("n"), F.col(f"r_{i}_{j}").alias("r"),
                )
            )
    return df.agg(*aggs).select(rows_of(items))


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _tiles(k: int, block: int, held: int) -> list[list[tuple[range, range]]]:
    """The upper triangle of column pairs as tiles, in groups that fit into ``held`` bytes; one group is one scan."""
    blocks = [range(at, min(at + block, k)) for at in range(0, k, block)]
    groups: list[list[tuple[range, range]]] = []
    size = held
    for i, rows in enumerate(blocks):
        for cols in blocks[i:]:
            need = 8 * len(_SUMS) * len(rows) * len(cols)
            if size + need > held:
                groups.append([])
                size = 0
            groups[-1].append((rows, cols))
            size += need
    return groups


def _tile_sums(df: DataFrame, names: Sequence[str], tiles: Sequence[tuple[range, range]], shift: np.ndarray) -> DataFrame:
    """(row, col, salt, sums): the sums of each tile in each task, one row per tile."""
    used = sorted({i for rows, cols in tiles for i in (*rows, *cols)})
    at = {i: j for j, i in enumerate(used)}
    parts = [(slice(at[r[0]], at[r[-1]] + 1), slice(at[c[0]], at[c[-1]] + 1)) for r, c in tiles]
    middle = shift[used]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(_SUMS), len(r), len(c))) for r, c in tiles]
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("float64")
            here = (~np.isnan(x)).astype("float64")
            x = np.where(here > 0, x - middle, 0.0)
            x2 = x * x
            for total, (r, c) in zip(sums, parts):
                for k, (left, right) in enumerate(((here, here), (x, here), (here, x), (x2, here), (here, x2), (x, x))):
                    total[k] += left[:, r].T @ right[:, c]
        salt = TaskContext.get().partitionId() % 256
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r, _ in tiles], pa.int32()), pa.array([c[0] for _, c in tiles], pa.int32()),
            pa.array([salt] * len(tiles), pa.int32()), pa.array([t.tobytes() for t in sums], pa.binary()),
        ], ["row", "col", "salt", "sums"])

    wide = df.select(*[number(names[i]).alias(f"c{i}") for i in used])
    return wide.mapInArrow(summed, _TILE_ROWS)


_TILE_ROWS = "row int, col int, salt int, sums binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sums of neighbouring rows of one tile: one tile is held at a time."""
    at, total = None, None
    for batch in batches:
        for row, col_, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            part = np.frombuffer(sums.as_buffer(), "float64")
            if at == (row, col_):
                total += part
            else:
                if at is not None:
                    yield *at, total
                at, total = (row, col_), part.copy()
    if at is not None:
        yield *at, total


def _pairs_by_tiles(df, cols, block, held):
    """Wide tables: matrix products per Arrow batch, added up in two steps so that no task takes all partial sums."""
    names, k = list(cols), len(cols)
    means = df.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means], dtype="float64")
    parts = reduce(DataFrame.unionByName, [_tile_sums(df, names, tiles, shift) for tiles in _tiles(k, block, held)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, col_, total in _added(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int32()), pa.array([col_], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                ["row", "col", "salt", "sums"],
            )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, col_, total in _added(batches):
            sums = total.reshape(len(_SUMS), min(block, k - row), min(block, k - col_))
            i, j = np.nonzero(np.arange(row, row + sums.shape[1])[:, None] < np.arange(col_, col_ + sums.shape[2])[None, :])
            yield pa.RecordBatch.from_arrays(
                [pa.array((row + i).astype("int32")), pa.array((col_ + j).astype("int32")), *[pa.array(s[i, j]) for s in sums]], ["i", "j", *_SUMS]
            )

    some = parts.repartition("row", "col", "salt").sortWithinPartitions("row", "col").mapInArrow(add, _TILE_ROWS)
    s = some.repartition("row", "col").sortWithinPartitions("row", "col").mapInArrow(pairs, "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS))
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    # A constant column leaves only rounding noise of its second moment.
    solid = (vx > F.lit(1e-12) * F.col("sxx")) & (vy > F.lit(1e-12) * F.col("syy"))
    r = F.when(solid, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    label = F.array(*[F.lit(c) for c in names])
    return s.select(
        label[F.col("i")].alias("var1"), label[F.col("j")].alias("var2"), F.col("n").cast("bigint").alias("n"), r.alias("r")
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The full square matrix in long form (both triangles and the diagonal)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    pairs = correlation_pairs(df, cols)
    both = F.array(
        F.struct(F.col("var1"), F.col("var2")), F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2"))
    )
    square = pairs.select(F.explode(both).alias("p"), "n", "r").select("p.var1", "p.var2", "n", "r")
    m = moments(df, cols).select(
        F.col("column").alias("var1"), F.col("column").alias("var2"), "n",
        F.when(F.col("std") > 0, F.lit(1.0)).alias("r"),
    )
    return square.unionByName(m)


def high_correlations(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    return correlation_pairs(df, cols).where(F.abs("r") > threshold).select(
        "var1", "var2", F.col("r").alias("correlation")
    )


# -------------------------------------------------------------------- outliers


def iqr_fences(df: DataFrame, cols: Sequence[str], factor: float = 1.5, method: str = "auto") -> DataFrame:
    q = exact_quantiles(df, cols, [0.25, 0.75], method=method)
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select(
        "column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"),
        (F.col("q")[0] - F.lit(factor) * iqr).alias("low"), (F.col("q")[1] + F.lit(factor) * iqr).alias("high"),
    )


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5, method: str = "auto") -> DataFrame:
    """(column, low, high, outliers, outlier_pct); the share is of all rows.

    The fences are one row per column and go along as a broadcast table.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, low double, high double, outliers bigint, outlier_pct double")
    found = {r["column"]: (r["low"], r["high"]) for r in iqr_fences(df, cols, factor, method).collect()}
    fences = spark.createDataFrame([(c, *found.get(c, (None, None))) for c in cols], "column string, low double, high double")
    long = df.select(*[number(c).alias(c) for c in cols]).unpivot([], [col(c) for c in cols], "column", "value")
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    counts = long.join(F.broadcast(fences), "column").groupBy("column", "low", "high").agg(
        F.count_if(outside).alias("outliers"), F.count(F.lit(1)).alias("_rows")
    )
    return counts.select("column", "low", "high", "outliers", percent(F.col("outliers"), F.col("_rows")).alias("outlier_pct"))
