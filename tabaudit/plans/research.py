"""Top predictors of an outcome, each with its test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.config import RESEARCH, AuditProfile
from tabaudit.functions.columns import numeric_columns, significance_strict
from tabaudit.operators import cleaning, hypothesis, metrics, modelling
from tabaudit.operators.encoding import profile_features, target_labels
from tabaudit.operators.scale import materialize
from tabaudit.operators.structure import analyse_structure


@dataclass
class Findings:
    study: str
    outcome: str
    auc: float
    predictors: DataFrame      # rank, feature, column, importance, test, p_value, significance
    importances: DataFrame


def research(df: DataFrame, name: str = "study", profile: AuditProfile = RESEARCH) -> Findings | None:
    """Fit on all rows, take the strongest inputs, test their source columns."""
    spark = df.sparkSession
    found = analyse_structure(df, profile)
    if found.target is None or not found.predictors:
        return None
    target = found.target
    data = materialize(cleaning.drop_empty_columns(found.df), "research")
    predictors = [p for p in found.predictors if p in data.columns]
    filled = cleaning.impute_text(cleaning.impute_zero(data), profile.categorical_fill)
    labels = target_labels(filled, target)
    inputs = profile_features(filled, predictors, profile)
    table = modelling.model_table(filled, target, labels, inputs, seed=profile.seed)
    fitted = modelling.fit_and_score(table, len(labels), profile)
    if len(labels) == 2:
        pairs = fitted.scored.select("label", F.col("prob")[1].alias("prob"))
        auc = metrics.auc(pairs, "label", "prob").first()["auc"]
    else:
        auc = profile.multiclass_auc
    importances = modelling.importance_table(spark, inputs, fitted.importances)
    top = modelling.top_features(importances, profile.top_features).collect()
    ranks = [(i + 1, r["feature"], r["source"], r["importance"]) for i, r in enumerate(top)]
    ranked = spark.createDataFrame(ranks, "rank int, feature string, column string, importance double")
    sources = list(dict.fromkeys(r["source"] for r in top))
    numbers = [c for c in numeric_columns(data) if c in sources]
    texts = [c for c in sources if c not in numbers]
    tests = spark.createDataFrame([], "column string, test string, p_value double")
    if numbers:
        t = hypothesis.with_t_pvalue(hypothesis.t_test(data, target, numbers))
        tests = tests.unionByName(t.select("column", F.lit("T-Test").alias("test"), "p_value"))
    if texts:
        c = hypothesis.with_chi2_pvalue(hypothesis.chi_square(data, target, texts))
        tests = tests.unionByName(c.select("column", F.lit("Chi2").alias("test"), "p_value"))
    out = ranked.join(tests, "column", "left").select(
        "rank", "feature", "column", "importance", "test", "p_value",
        significance_strict(F.coalesce("p_value", F.lit(1.0))).alias("significance"),
    )
    return Findings(name, target, auc, out, importances)


def report_lines(found: Findings) -> DataFrame:
    """The findings as text lines."""
    spark = found.predictors.sparkSession
    head = [(0, f"STUDY: {found.study}"), (1, f"PRIMARY OUTCOME: {found.outcome}"), (2, f"PREDICTIVE POWER (AUC): {found.auc:.3f}")]
    top = spark.createDataFrame(head, "line_no int, line string")
    body = found.predictors.select(
        (F.col("rank") + 2).alias("line_no"),
        F.format_string("PREDICTOR: %s | P-Value: %.4e %s", "column", "p_value", "significance").alias("line"),
    )
    return top.unionByName(body)
