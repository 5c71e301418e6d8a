"""Predictors that give the outcome away: by correlation and by a small forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from tabaudit.config import AUDIT, AuditProfile
from tabaudit.functions.columns import col, numeric_columns
from tabaudit.operators.cleaning import impute_median
from tabaudit.operators.encoding import code_expression, features, target_labels
from tabaudit.operators.modelling import fit_forest, importance_table
from tabaudit.operators.quality import correlations_with
from tabaudit.operators.scale import materialize, random_rows, smallest_by_hash


def scalar_leaks(df: DataFrame, target: str, predictors: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """(column, r): correlation of numeric predictors with the class code, one pass."""
    cols = [c for c in numeric_columns(df) if c in predictors]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, r double")
    return correlations_with(df, code_expression(col(target), labels or target_labels(df, target)), cols)


def model_importances(
    df: DataFrame, target: str, predictors: Sequence[str], profile: AuditProfile = AUDIT, keys: Sequence[str] | None = None
) -> DataFrame | None:
    """(feature, source, importance) of a small forest on a bounded sample."""
    cols = list(dict.fromkeys([*(keys or []), *predictors, target]))
    pick = df.select(*[col(c) for c in cols])
    sample = smallest_by_hash(pick, profile.leak_rows, keys, salt=profile.seed) if keys else random_rows(
        pick, profile.leak_rows, seed=profile.seed
    )
    sample = materialize(sample, "leak")
    if sample.count() < profile.leak_min_rows:
        return None
    sample = impute_median(sample, [c for c in numeric_columns(sample) if c in predictors])
    inputs = features(sample, predictors, one_hot_max=10**9)
    if not inputs:
        return None
    names = [f"f{i}" for i in range(len(inputs))]
    y = code_expression(col(target), target_labels(sample, target))
    flat = sample.select(y.alias("label"), *[f.value.alias(n) for n, f in zip(names, inputs)])
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(flat).select("label", "features")
    forest = fit_forest(vec, profile.leak_trees, profile.leak_depth, profile.seed)
    return importance_table(df.sparkSession, inputs, forest.featureImportances.toArray())


def hunt(
    df: DataFrame, target: str, predictors: Sequence[str], profile: AuditProfile = AUDIT, keys: Sequence[str] | None = None
) -> tuple[list[str], list[tuple[str, str, float]]]:
    """(kept predictors, removed as (column, reason, measure)).

    A predictor survives the forest if at least one of its inputs does.
    """
    removed: list[tuple[str, str, float]] = []
    keep = list(predictors)
    if profile.leak_correlation is not None:
        for r in scalar_leaks(df, target, keep).collect():
            if r["r"] is not None and abs(r["r"]) > profile.leak_correlation:
                removed.append((r["column"], "correlation", float(r["r"])))
        gone = {c for c, _, _ in removed}
        keep = [c for c in keep if c not in gone]
    if profile.leak_importance is not None and keep:
        table = model_importances(df, target, keep, profile, keys)
        if table is not None:
            best: dict[str, list[float]] = {}
            for r in table.collect():
                best.setdefault(r["source"], []).append(r["importance"])
            # A predictor without any input, such as a constant text, has nothing to leak with.
            leaks = {s for s, v in best.items() if min(v) > profile.leak_importance}
            removed += [(c, "importance", max(best[c])) for c in keep if c in leaks]
            keep = [c for c in keep if c not in leaks]
    return keep, removed
