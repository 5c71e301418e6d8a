"""Building blocks that keep the other operators safe on very large tables.

* running totals over a sorted column without a single-task window,
* exact quantiles without holding a column in one aggregation buffer,
* the n rows with the smallest hash without sorting the table,
* a join that splits hot keys,
* a written table that cuts lineage and survives executor loss.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Up to this estimated input size the one-pass forms are used: `percentile`
# keeps every distinct value of a column in one buffer, and a window that is
# only partitioned by column name sorts that column in one task.
SMALL_BYTES = 256 * 1024 * 1024

# Below this the built-in `percentile` aggregate is the quickest way.
DIRECT_BYTES = 1024 * 1024

# Small tables (quantile brackets, bucket offsets, schema facts) are broadcast
# only below this many rows.
BROADCAST_ROWS = 100_000


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    return plan_bytes(df) <= (SMALL_BYTES if limit is None else limit)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    Taken from ``spark.checkpoint.dir``.  Only a local session may fall back
    to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_tabaudit_scratch", None)
    if made is None:
        made = spark._tabaudit_scratch = tempfile.mkdtemp(prefix="tabaudit-")
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later jobs read pruned columns, recompute nothing and survive the loss of
    executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, list[dict] | None]:
    """Bring a table that should be small to the driver, after checking it is.

    Returns (table, rows).  Above ``limit`` rows the table is written instead
    and rows is ``None``.
    """
    found = df.limit(limit + 1).toArrow()
    if found.num_rows > limit:
        return materialize(df, "side"), None
    return df.sparkSession.createDataFrame(found, df.schema), found.to_pylist()


def join_small(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a side table that is broadcast only if it proves small."""
    table, rows = small_table(side)
    return df.join(F.broadcast(table) if rows is not None else table, list(on), how)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a small input, which often sits
    in a single file split; large inputs have splits enough and pass through."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df


# --------------------------------------------------------------- running totals


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    small: bool | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` for every summed column ``s``.

    ``<s>_before`` is the total over rows of the same group with a smaller
    ``order``; the input holds one row per (group, order) value.  Large input
    is written once in range-partitioned buckets; the bucket totals give each
    bucket its offset and every bucket is then summed on its own, so no task
    sees a whole group.
    """
    by = list(by)
    if small is None:
        small = is_small(df)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    if small:
        run = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            "*",
            *[F.coalesce(F.sum(s).over(run), F.lit(0)).cast(_sum_type(df, s)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
        )

    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(n, *by, order).withColumn("_bucket", F.spark_partition_id()), "ranges"
    )
    run = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most (buckets + groups) rows: a group spans neighbouring buckets.
    offsets = (
        placed.groupBy(*by, "_bucket")
        .agg(*[F.sum(s).alias(f"_{s}_b") for s in sums])
        .select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
            F.col("_bucket").alias("_at"),
            *[F.coalesce(F.sum(f"_{s}_b").over(run), F.lit(0)).alias(f"_{s}_off") for s in sums],
            *[F.sum(f"_{s}_b").over(group).alias(f"{s}_total") for s in sums],
        )
    )
    inner = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.select("*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_{s}_in") for s in sums])
    on = all_of(
        [F.col("_bucket") == F.col("_at")] + [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    )
    return within.join(offsets, on, "inner").select(
        *df.columns,
        *[(F.col(f"_{s}_in") + F.col(f"_{s}_off")).cast(_sum_type(df, s)).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def _sum_type(df: DataFrame, name: str) -> str:
    return "double" if df.schema[name].dataType.typeName() in ("double", "float") else "bigint"


def all_of(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


# ------------------------------------------------------------------- quantiles


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _number(name: str) -> Column:
    x = _quoted(name).cast("double")
    return F.when(~F.isnan(x), x)


def unpivot_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value) with NULLs dropped and everything as DOUBLE."""
    wide = df.select(*by, *[_number(c).alias(c) for c in cols])
    return wide.unpivot(list(by), [F.col("`" + c.replace("`", "``") + "`") for c in cols], "column", "value").where(
        "value is not null"
    )


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    method: str = "auto",
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles: rows (by..., column, n, q), q an array.

    ``method='direct'`` uses the built-in ``percentile``, which keeps every
    distinct value in one buffer.  ``'distributed'`` scans twice: quantile
    sketches bracket each quantile, then only the values inside a bracket are
    kept and the exact rank is found among those; a bracket that missed is
    settled over all values.  ``'auto'`` takes the first only for tables of
    about a megabyte.  ``sketches``, rows as of ``quantile_sketches``, save
    the first scan.
    """
    cols, probs, by = list(cols), [float(p) for p in probs], list(by)
    if method == "auto":
        method = "direct" if is_small(df.select(*by, *cols), DIRECT_BYTES) else "distributed"
    if method == "direct":
        return _quantiles_direct(df, cols, probs, by)
    return _quantiles_distributed(df, cols, probs, by, sketches)


def _quantiles_direct(df, cols, probs, by):
    aggs = []
    for i, c in enumerate(cols):
        x = _number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.percentile(x, F.array(*map(F.lit, probs))).alias(f"q{i}")]
    items = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"q{i}").alias("q"))
            for i, c in enumerate(cols)
        ]
    )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(items)).where("n > 0")


# Values kept by a quantile sketch, and how far ranks taken from it are off at most in 99 of 100 cases (published bound).
SKETCH_VALUES = 4096


def _rank_error(k: int) -> float:
    return 2.296 / k**0.9021


def quantile_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, sketch): mergeable quantile sketches of bounded size in one scan."""
    return unpivot_numeric(spread(df.select(*by, *[_quoted(c) for c in cols])), cols, by).groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(SKETCH_VALUES)).alias("sketch")
    )


def _brackets(sketches: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Value range of every quantile, three error bounds to either side: (by..., column, n, _lo*, _hi*)."""
    margin = 3 * _rank_error(SKETCH_VALUES)
    ranks = F.array(*[F.lit(min(1.0, max(0.0, p + sign * margin))) for p in probs for sign in (-1, 1)])
    found = sketches.where("n > 0").withColumn("_s", F.kll_sketch_get_quantile_double("sketch", ranks))
    ends = []
    for j, p in enumerate(probs):
        ends.append((F.lit(float("-inf")) if p <= margin else F.col("_s")[2 * j]).alias(f"_lo{j}"))
        ends.append((F.lit(float("inf")) if p >= 1 - margin else F.col("_s")[2 * j + 1]).alias(f"_hi{j}"))
    return found.select(*by, "column", "n", *ends)


def _quantiles_distributed(df, cols, probs, by, sketches=None, whole=False):
    k = len(probs)
    keys = [*by, "column"]
    long = unpivot_numeric(spread(df.select(*by, *[_quoted(c) for c in cols])), cols, by)
    small = None
    if whole:
        tagged = long.select(*keys, "value", F.lit(0).alias("_gap"), F.col("value").alias("_v"))
    else:
        side, rows = small_table(_brackets(sketches if sketches is not None else quantile_sketches(df, cols, by), probs, by))
        # Few values lie inside the brackets.
        small = rows is not None and sum(r["n"] for r in rows) * 6 * k * _rank_error(SKETCH_VALUES) < 4_000_000
        side = side.drop("n").withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(keys)})
        # Brackets begun minus brackets passed: positive inside, and the number
        # passed tells the gaps apart.  Groups without brackets keep everything.
        begun = " + ".join(f"int(_lo{j} <= value)" for j in range(k))
        passed = " + ".join(f"int(_hi{j} < value)" for j in range(k))
        on = all_of([F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(keys)])
        placed = long.join(F.broadcast(side) if rows is not None else side, on, "left").select(
            *keys, "value", F.expr(begun).alias("_begun"), F.expr(passed).alias("_gap")
        )
        tagged = placed.select(
            *keys, "value", F.expr("coalesce(_gap, 0)").alias("_gap"),
            F.expr("CASE WHEN _begun <= _gap THEN NULL ELSE value END").alias("_v"),
        )
    # Inside a bracket every value counts; outside, one row per gap is enough.
    counted = tagged.groupBy(*keys, "_gap", "_v").agg(F.count(F.lit(1)).alias("cnt"), F.min("value").alias("_ord"))
    ranked = running_totals(counted, "_ord", ["cnt"], keys, small=small)
    picks, q = [], []
    for i, p in enumerate(probs):
        for tag, step in (("a", "floor"), ("b", "ceil")):
            rank = f"{step}((cnt_total - 1) * {p!r}D)"
            picks.append(F.expr(f"max(CASE WHEN cnt_before <= {rank} AND {rank} < cnt_before + cnt THEN _v END)").alias(f"_{tag}{i}"))
        # Same rounding as the built-in percentile.
        at = f"((n - 1) * {p!r}D)"
        q.append(F.expr(
            f"CASE WHEN _a{i} = _b{i} THEN _a{i} ELSE (ceil({at}) - {at}) * _a{i} + ({at} - floor({at})) * _b{i} END"))
    picked = ranked.groupBy(*keys).agg(F.max("cnt_total").alias("n"), *picks)
    result = picked.select(*keys, "n", F.array(*q).alias("q"))
    if whole:
        return result
    table, rows = small_table(result)
    if rows is None:
        # Very many groups: the answer is itself a large table, check it in place.
        if not table.where(F.exists("q", lambda x: x.isNull())).limit(1).count():
            return table
        return _quantiles_distributed(df, cols, probs, by, whole=True)
    missed = sorted({r["column"] for r in rows if any(x is None for x in r["q"])})
    if not missed:
        return table
    # A bracket missed its rank: settle those columns over the full value range.
    good = table.where(~F.col("column").isin(missed))
    return good.unionByName(_quantiles_distributed(df, missed, probs, by, whole=True))


def counted_quantiles(counts: DataFrame, value: str, cnt: str, probs: Sequence[float], small: bool | None = None) -> list[float]:
    """Exact quantiles of values given with their counts (one row per value)."""
    ranked = running_totals(counts.select(value, cnt), value, [cnt], small=small)
    total = counts.agg(F.sum(cnt).alias("n")).first()["n"] or 0
    if not total:
        return []
    at = [(total - 1) * p for p in probs]
    ranks = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})
    held = f"filter(array({', '.join(f'{r}L' for r in ranks)}), r -> {cnt}_before <= r AND r < {cnt}_before + {cnt})"
    # One row per wanted rank.
    rows = ranked.select(F.col(value).alias("v"), F.explode(F.expr(held)).alias("r")).collect()
    found = {r["r"]: r["v"] for r in rows}
    out = []
    for a in at:
        low, high = found[math.floor(a)], found[math.ceil(a)]
        out.append(low if low == high else (math.ceil(a) - a) * low + (a - math.floor(a)) * high)
    return out


def quantile_values(df, cols, probs, method="auto") -> dict[str, list[float]]:
    """Column quantiles as plain numbers (one row per column)."""
    if not cols:
        return {}
    return {r["column"]: list(r["q"]) for r in exact_quantiles(df, cols, probs, method=method).collect()}


# --------------------------------------------------------------- hash sampling


def unit_hash(*cols: str, salt: int | str = "") -> Column:
    """A uniform number in [0, 1) from the md5 of the key; same on any engine."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(salt)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


# Hash levels to each power of two: the last one taken holds about 4 % of what lies below it.
LEVELS = 16


def hash_level(h: Column) -> Column:
    """Level of a ``unit_hash``, larger for larger hashes: about 530 in all, finer the closer to zero."""
    return F.floor(F.log2(h + F.lit(2.0**-33)) * LEVELS)


def smallest_by_hash(
    df: DataFrame,
    n: int,
    keys: Sequence[str],
    by: Sequence[str] = (),
    salt: int | str = 42,
    hashed: str | None = None,
) -> DataFrame:
    """The ``n`` rows (per group) with the smallest key hash.

    A count per hash level says how far to look, so only about ``n`` rows per
    group are ever sorted, and a task counts a bounded number of levels
    whatever its rows.  Ties are broken on the key itself.  ``hashed`` names a
    column that holds the hash of the keys already.
    """
    keys, by = list(keys), list(by)
    placed = df.withColumn("_h", F.col(hashed) if hashed else unit_hash(*keys, salt=salt))
    level = hash_level(F.col("_h"))
    counts = placed.groupBy(*by, level.alias("_lvl")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    run = group.orderBy("_lvl").rowsBetween(Window.unboundedPreceding, -1)
    # Highest level that still holds one of the n smallest.
    edge = (
        counts.withColumn("_b", F.coalesce(F.sum("_n").over(run), F.lit(0)))
        .where(F.col("_b") < n)
        .groupBy(*by)
        .agg(F.max("_lvl").alias("_edge"))
    )
    order = [F.col("_h"), *[F.col(k) for k in keys]]
    if not by:
        row = edge.first()
        return placed.where(level <= F.lit(row["_edge"] if row else None)).orderBy(*order).limit(n).drop("_h")
    side, rows = small_table(edge)
    if rows:
        # Rows above the highest edge go before anything else is computed of them.
        placed = placed.where(level <= max(r["_edge"] for r in rows))
    near = placed.join(F.broadcast(side) if rows is not None else side, by).where(level <= F.col("_edge"))
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        near.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .select(*df.columns)
    )


def random_rows(df: DataFrame, n: int, rows: int | None = None, seed: int = 42) -> DataFrame:
    """A uniform sample of ``n`` rows when no key identifies a row.

    Rows that draw a small number are ordered by it and the first ``n`` stay,
    so every part of the table is drawn from alike.
    """
    total = df.count() if rows is None else rows
    if total <= n:
        return df
    share = min(1.0, (n + 10 * math.sqrt(n) + 10) / total)
    return df.withColumn("_draw", F.rand(seed)).where(F.col("_draw") < F.lit(share)).orderBy("_draw").limit(n).drop("_draw")


# ---------------------------------------------------------------- skewed joins


def split_hot_keys(
    big: DataFrame,
    unique: DataFrame,
    big_key: str,
    unique_key: str,
    hot_share: float = 0.01,
    ways: int = 64,
) -> DataFrame:
    """Inner join of ``big`` with a side that holds each key at most once.

    Keys with more than ``hot_share`` of the big side (at most 1/share keys)
    are spread over ``ways`` tasks; their single partner row is repeated.
    NULL keys match each other.  The salt is a hash of the whole row, so a task
    that is repeated deals its rows as before.
    """
    counts = big.groupBy(F.col(big_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    total = big.count()
    hot_rows = counts.where(F.col("_n") > F.lit(max(1.0, hot_share * total))).select("_k").collect()
    hot = [r["_k"] for r in hot_rows]
    plain = [k for k in hot if k is not None]
    if not hot:
        return big.join(unique, big[big_key].eqNullSafe(unique[unique_key]), "inner")

    def is_hot(col: Column) -> Column:
        cond = F.coalesce(col.isin(plain), F.lit(False)) if plain else F.lit(False)
        return cond | col.isNull() if None in hot else cond

    left = big.withColumn(
        "_salt", F.when(is_hot(F.col(big_key)), F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in big.dtypes]), F.lit(ways)).cast("int")).otherwise(F.lit(0))
    )
    right = unique.withColumn(
        "_salt2",
        F.explode(F.when(is_hot(F.col(unique_key)), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))),
    )
    joined = left.join(
        right, left[big_key].eqNullSafe(right[unique_key]) & (F.col("_salt") == F.col("_salt2")), "inner"
    )
    return joined.drop("_salt", "_salt2")
