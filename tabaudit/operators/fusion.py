"""Finding a join key between tables by content, and joining on it."""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col, scalar_columns
from tabaudit.operators.scale import is_small, materialize, small_table, split_hot_keys


# Of each column about so many distinct values are looked at before any is compared exactly.
SKETCH = 4096
# A pair is ruled out when its sampled overlap lies so many standard deviations below the threshold.
DEVIATIONS = 6.0

_PAIRS = (
    "table1 string, column1 string, table2 string, column2 string, distinct1 bigint, distinct2 bigint, "
    "common bigint, ratio double, position bigint"
)


def _cells(df: DataFrame, numbers: Mapping[str, int]) -> DataFrame:
    """(id, value): the present values of the numbered columns as text."""
    long = df.select(*[col(c).cast("string").alias(str(i)) for c, i in numbers.items()]).unpivot(
        [], [col(str(i)) for i in numbers.values()], "id", "value"
    )
    return long.where("value is not null").select(F.col("id").cast("int").alias("id"), "value")


def _cells_of(tables: Sequence[DataFrame], columns: Sequence[tuple[int, str]], ids: Collection[int]) -> DataFrame | None:
    """The cells of some columns of all tables; each table reads only those."""
    out = None
    for t, df in enumerate(tables):
        own = {columns[i][1]: i for i in sorted(ids) if columns[i][0] == t}
        if own:
            out = _cells(df, own) if out is None else out.unionByName(_cells(df, own))
    return out


# 62 bits of hash; a value is in the sample of level L if its last L bits are zero.
def _hash() -> Column:
    return F.shiftrightunsigned(F.xxhash64("value"), 2).alias("h")


def _overlaps(held: DataFrame, key: str) -> DataFrame:
    """(a, b, common): for each two ids the keys that both hold; ids that occur together are counted first."""
    together = (
        held.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
        .groupBy("ids").agg(F.count(F.lit(1)).alias("n"))
    )
    pair = together.select("n", F.explode("ids").alias("a"), "ids").select("n", "a", F.explode("ids").alias("b"))
    return pair.where("a < b").groupBy("a", "b").agg(F.sum("n").alias("common"))


def _sketches(tables, columns, kept: int) -> tuple[DataFrame, list[int], list[float]]:
    """Samples (id, h) of about ``kept`` distinct values of each column, with levels and estimated distinct counts."""
    every = _cells_of(tables, columns, range(len(columns)))
    found = {r["id"]: r["n"] for r in every.groupBy("id").agg(F.approx_count_distinct("value", 0.02).alias("n")).collect()}
    counts = [float(found.get(i, 0)) for i in range(len(columns))]
    levels = [max(0, math.ceil(math.log2(n / kept))) if n else 0 for n in counts]
    mask = F.array(*[F.lit((1 << level) - 1).cast("bigint") for level in levels])[F.col("id")]
    # Most cells of a large column go before anything is shuffled.
    return materialize(every.select("id", _hash()).where(F.col("h").bitwiseAND(mask) == 0).distinct(), "sketch"), levels, counts


def _possible_pairs(sketch: DataFrame, columns, levels, threshold: float, min_distinct: int) -> list[tuple[int, int]]:
    """Pairs of columns that may exceed the threshold."""
    h = F.col("h")
    zeros = F.when(h == 0, F.lit(62)).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")
    # At most 63 rows per column and one per pair of columns.
    at: dict[int, dict[int, int]] = {}
    for r in sketch.groupBy("id", zeros.alias("z")).agg(F.count(F.lit(1)).alias("n")).collect():
        at.setdefault(r["id"], {})[r["z"]] = r["n"]
    met = {(r["a"], r["b"]): r["common"] for r in _overlaps(sketch, "h").collect()}
    usable = [i for i in sorted(at) if levels[i] or sum(at[i].values()) >= min_distinct]

    def implausible(common: int, sampled: int) -> bool:
        return common < threshold * sampled - DEVIATIONS * math.sqrt(max(threshold * (1 - threshold), 0.0) * sampled)

    pairs = []
    for k, a in enumerate(usable):
        for b in usable[k + 1 :]:
            if columns[a][0] == columns[b][0]:
                continue
            level = max(levels[a], levels[b])
            sampled = [sum(n for z, n in at[i].items() if z >= level) for i in (a, b)]
            if not all(implausible(met.get((a, b), 0), n) for n in sampled):
                pairs.append((a, b))
    return pairs


def key_candidates(
    tables: Mapping[str, DataFrame],
    threshold: float = 0.6,
    min_distinct: int = 5,
    heads: int | None = None,
    kept: int = SKETCH,
    method: str = "auto",
) -> DataFrame:
    """Column pairs of different tables whose values contain each other.

    (table1, column1, table2, column2, distinct1, distinct2, common, ratio,
    position); ``ratio`` is the share of the smaller value set found in the
    larger.  ``heads`` looks at the first rows of each table only.

    Hash samples of the distinct values rule out most pairs.  The others are
    compared exactly, value by value: columns of up to about ``kept`` values
    whole, larger ones whole only against each other, and by the values of
    the small ones otherwise.  Only their cells are shuffled.  ``'direct'``
    (small tables) compares all columns whole, ``'sketched'`` rules out first.
    """
    names = list(tables)
    spark = next(iter(tables.values())).sparkSession
    frames = [tables[n] if heads is None else materialize(tables[n].limit(heads), "heads") for n in names]
    columns = [(t, c) for t, df in enumerate(frames) for c in scalar_columns(df)]
    order = [i - min(j for j, (u, _) in enumerate(columns) if u == t) for i, (t, _) in enumerate(columns)]
    if len({t for t, _ in columns}) < 2:
        return spark.createDataFrame([], _PAIRS)
    if method == "auto":
        method = "direct" if all(is_small(df) for df in frames) else "sketched"
    if method == "direct":
        levels, guess = [0] * len(columns), [0.0] * len(columns)
        pairs = [(a, b) for b in range(len(columns)) for a in range(b) if columns[a][0] != columns[b][0]]
    else:
        sketch, levels, guess = _sketches(frames, columns, kept)
        pairs = _possible_pairs(sketch, columns, levels, threshold, min_distinct)
    if not pairs:
        return spark.createDataFrame([], _PAIRS)

    partners: dict[int, set[int]] = {}
    for a, b in pairs:
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    # A large column that meets only small ones is asked for their values.
    asked = {i for i, others in partners.items() if levels[i] and not any(levels[o] for o in others)}
    whole = set(partners) - asked
    values = _cells_of(frames, columns, whole)
    if asked:
        wanted = sketch.where(F.col("id").isin(*{o for i in asked for o in partners[i]})).select("h").distinct()
        side, rows = small_table(wanted)
        picked = _cells_of(frames, columns, asked).withColumn("h", _hash()).join(F.broadcast(side) if rows is not None else side, "h", "left_semi").drop("h")
        values = picked if values is None else values.unionByName(picked)
    # Copies of a value collapse before the shuffle; the cells are read once.
    values = materialize(values.distinct(), "values")
    known = {r["id"]: r["n"] for r in values.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect() if r["id"] in whole}
    found = {(r["a"], r["b"]): r["common"] for r in _overlaps(values, "value").collect()}
    # One row per pair of columns.  Exact counts of the columns that were only asked, where a pair may pass.
    open_pairs = [(a, b) for a, b in pairs if found.get((a, b), 0) > threshold * min(known.get(i, guess[i] * 0.8) for i in (a, b))]
    missing = {i for p in open_pairs for i in p if i not in known}
    if missing:
        counted = _cells_of(frames, columns, missing).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        known.update({r["id"]: r["n"] for r in counted.collect()})
    width = max(order) + 1
    out = []
    for a, b in open_pairs:
        (t1, c1), (t2, c2) = columns[a], columns[b]
        ratio = found[a, b] / min(known[a], known[b])
        if ratio > threshold and min(known[a], known[b]) >= min_distinct:
            place = (t1 * len(names) + t2) * width * width + order[a] * width + order[b]
            out.append((names[t1], c1, names[t2], c2, known[a], known[b], found[a, b], ratio, place))
    return spark.createDataFrame(out, _PAIRS)


def is_unique(df: DataFrame, column: str) -> bool:
    """No value (missing ones included) occurs twice."""
    return not df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()


def fuse(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame | None:
    """Inner join on keys of different names; ``None`` if both sides repeat keys.

    Clashing column names get ``_x`` / ``_y``; missing keys match each other;
    keys of different types are compared as text.
    """
    shared = set(left.columns) & set(right.columns)
    same = left_key == right_key
    if same:
        shared.discard(left_key)
    a = left.withColumnsRenamed({c: f"{c}_x" for c in shared})
    b = right.withColumnsRenamed({c: f"{c}_y" for c in shared})
    ka = f"{left_key}_x" if left_key in shared else left_key
    kb = f"{right_key}_y" if right_key in shared else right_key
    if same:
        kb = f"{right_key}__right"
        b = b.withColumnRenamed(right_key, kb)
    out = [c for c in [*a.columns, *b.columns] if not (same and c == kb)]
    text_keys = a.schema[ka].dataType != b.schema[kb].dataType
    a = a.withColumn("_ka", col(ka).cast("string") if text_keys else col(ka))
    b = b.withColumn("_kb", col(kb).cast("string") if text_keys else col(kb))
    if is_unique(b, "_kb"):
        joined = split_hot_keys(a, b, "_ka", "_kb")
    elif is_unique(a, "_ka"):
        joined = split_hot_keys(b, a, "_kb", "_ka")
    else:
        return None
    return joined.select(*[col(c) for c in out])


def auto_fuse(tables: Mapping[str, DataFrame], threshold: float = 0.6, heads: int | None = None) -> tuple[DataFrame, str] | None:
    """Join the first pair of tables that share a key; ``None`` if there is no
    safe pair or nothing matches."""
    found = fuse_first_pair(tables, threshold, heads)
    return found and found[:2]


def fuse_first_pair(
    tables: Mapping[str, DataFrame], threshold: float = 0.6, heads: int | None = None
) -> tuple[DataFrame, str, tuple[str, str]] | None:
    """As ``auto_fuse``, with the names of the two tables."""
    first = key_candidates(tables, threshold, heads=heads).orderBy("position").first()
    if first is None:
        return None
    fused = fuse(tables[first["table1"]], tables[first["table2"]], first["column1"], first["column2"])
    if fused is None or not fused.limit(1).count():
        return None
    return fused, f"FUSED_{first['table1'][:5]}_{first['table2'][:5]}.csv", (first["table1"], first["table2"])
