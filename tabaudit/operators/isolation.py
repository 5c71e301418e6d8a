"""Isolation forest: multivariate outlier removal.

Trees are grown on small bounded subsamples, one task per group of trees;
scoring is a vectorised pass over the whole table with the node arrays as a
closure of fixed size (trees x nodes).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabaudit.functions.columns import col, numeric_columns
from tabaudit.operators.scale import materialize, quantile_values, random_rows, smallest_by_hash, spread, unit_hash

# Rows a tree is grown on.
TREE_ROWS = 256

_NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (id, feature, threshold, left, right, path); leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    made = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((node, -1, 0.0, -1, -1, depth + expected_path(len(rows))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        left = part[:, f] <= cut
        nodes.append((node, f, cut, made, made + 1, 0.0))
        todo += [(made, rows[left], depth + 1), (made + 1, rows[~left], depth + 1)]
        made += 2
    return nodes


@dataclass
class IsolationForest:
    """A grown forest.

    Every tree is laid out as a complete binary tree (children of i are 2i+1
    and 2i+2), so a row takes exactly ``depth`` steps without branching.
    """

    cols: list[str]
    depth: int
    feature: np.ndarray      # trees x inner nodes
    threshold: np.ndarray    # trees x inner nodes, +inf below a leaf
    path: np.ndarray         # trees x bottom nodes
    norm: float

    def score_array(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1] of every row of ``x``."""
        n, k = x.shape
        flat = np.ascontiguousarray(x).ravel()
        base = np.arange(n, dtype=np.int64) * k
        total = np.zeros(n)
        first = 2**self.depth - 1
        for feature, cut, path in zip(self.feature, self.threshold, self.path):
            at = np.zeros(n, dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (flat[base + feature[at]] > cut[at])
            total += path[at - first]
        return np.power(2.0, -(total / len(self.feature)) / self.norm)

    def score(self, *inputs: Column) -> Column:
        forest = self

        @F.pandas_udf(DoubleType())
        def run(*parts: pd.Series) -> pd.Series:
            x = np.column_stack([p.to_numpy(dtype="float64", na_value=0.0) for p in parts])
            return pd.Series(forest.score_array(x))

        return run(*inputs)


def lay_out(nodes: pd.DataFrame, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Complete-tree arrays from grown nodes; a leaf repeats down its left side."""
    inner, bottom = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    path = np.zeros((trees, bottom))
    for t, part in nodes.groupby("tree"):
        part = part.set_index("node")
        split, cut = part["feature"].to_dict(), part["threshold"].to_dict()
        left, right, mean = part["left"].to_dict(), part["right"].to_dict(), part["path"].to_dict()
        todo = [(0, 0)]
        while todo:
            node, at = todo.pop()
            if split[node] >= 0:
                feature[t, at], threshold[t, at] = split[node], cut[node]
                todo += [(left[node], 2 * at + 1), (right[node], 2 * at + 2)]
                continue
            while at < inner:
                at = 2 * at + 1
            path[t, at - inner] = mean[node]
    return feature, threshold, path


def fit(
    df: DataFrame,
    cols: Sequence[str],
    trees: int = 100,
    keys: Sequence[str] | None = None,
    total: int | None = None,
    seed: int = 42,
) -> IsolationForest:
    """Grow the forest; every tree gets up to 256 rows drawn from the whole table.

    ``keys`` make the draw independent of how the table is partitioned.  The
    rows never visit the driver, which only collects the grown nodes.
    """
    cols, keys = list(cols), list(keys or ())
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(cols))]
    need = trees * TREE_ROWS
    pick = df.select(*[col(c) for c in [*keys, *[c for c in cols if c not in keys]]])
    sample = smallest_by_hash(pick, need, keys, salt=seed) if keys else random_rows(pick, need, total, seed)
    # Dealt by another draw, so that equal rows are spread over the trees.
    draw = unit_hash(*keys, salt=f"deal-{seed}") if keys else F.rand(seed)
    values = [F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, cols)]
    sample = materialize(sample.select(draw.alias("_draw"), *values), "forest")
    m = sample.count()
    psi = min(TREE_ROWS, m)
    depth = max(1, math.ceil(math.log2(max(psi, 2))))

    # Tree t takes the places from t * psi on; a short sample is gone through again.
    # The window sees at most trees * 256 rows.
    place = F.row_number().over(Window.orderBy("_draw", *names)) - 1
    taken = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.col("_at") - t * psi, F.lit(m)) < psi)
    dealt = sample.withColumn("_at", place).select(F.explode(taken).alias("tree"), *names)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        local = np.random.default_rng([seed, tree])
        nodes = grow_tree(pdf[names].to_numpy(), local, depth)
        return pd.DataFrame(
            [(tree, *n) for n in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "path"]
        )

    # A stated number of partitions keeps these few rows from being put into one task.
    tasks = min(trees, spark.sparkContext.defaultParallelism)
    nodes = dealt.repartition(tasks, "tree").groupBy("tree").applyInPandas(build, _NODE_SCHEMA).toPandas()
    feature, threshold, path = lay_out(nodes, trees, depth)
    return IsolationForest(cols, depth, feature, threshold, path, expected_path(psi))


def remove_outliers(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    contamination: float = 0.05,
    min_rows: int = 500,
    keys: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Rows that the forest keeps; small or non-numeric tables pass unchanged."""
    scored = outlier_scores(df, cols, contamination, min_rows, keys, seed)
    return scored.where(~F.col("is_outlier")).select(*[col(c) for c in df.columns])


def outlier_scores(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    contamination: float = 0.05,
    min_rows: int = 500,
    keys: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """All rows with ``anomaly_score`` and ``is_outlier``.

    The cut is the exact quantile of the scores of all rows: up to ties, the
    stated share of the table is marked.
    """
    cols = list(cols) if cols is not None else [c for c in numeric_columns(df) if c not in (keys or [])]
    total = df.count()
    if total <= min_rows or not cols:
        return df.withColumns({"anomaly_score": F.lit(None).cast("double"), "is_outlier": F.lit(False)})
    forest = fit(df, cols, keys=keys, total=total, seed=seed)
    score = forest.score(*[F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])
    scored = materialize(spread(df).withColumn("anomaly_score", score), "scores")
    cut = quantile_values(scored, ["anomaly_score"], [1.0 - contamination])["anomaly_score"][0]
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(cut))
