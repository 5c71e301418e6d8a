"""The audit: structure, normality, leakage, healing, model, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.config import AUDIT, AuditProfile
from tabaudit.functions.columns import numeric_columns, string_columns
from tabaudit.operators import chartdata, cleaning, hypothesis, isolation, leakage, metrics, modelling
from tabaudit.operators.encoding import profile_features, target_labels
from tabaudit.operators.fusion import fuse_first_pair
from tabaudit.operators.scale import materialize, small_table
from tabaudit.operators.structure import analyse_structure
from tabaudit.sources.sinks import LOG_SCHEMA, log_rows

REPORT_SCHEMA = (
    "dataset string, status string, reason string, target string, auc double, rows_in bigint, rows_removed bigint, "
    "predictors bigint, arrested bigint, calibration string, ece double, normality string"
)


@dataclass
class AuditResult:
    """All outcomes of one audit as tables; ``report`` has one row."""

    report: DataFrame
    log: DataFrame
    target: str | None = None
    cleaned: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _report(spark, name, status, reason, **values) -> DataFrame:
    names = [f.split(" ")[0] for f in REPORT_SCHEMA.split(", ")]
    row = {"dataset": name, "status": status, "reason": reason, **values}
    return spark.createDataFrame([tuple(row.get(n) for n in names)], REPORT_SCHEMA)


def _stop(spark, name, status, reason, **values) -> AuditResult:
    return AuditResult(
        _report(spark, name, status, reason, **values), log_rows(spark, [(name, status, reason)]), values.get("target")
    )


def heal(df: DataFrame, profile: AuditProfile = AUDIT, target: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Drop empty columns, impute, remove multivariate outliers."""
    df = cleaning.drop_empty_columns(df)
    numbers = [c for c in numeric_columns(df) if c not in (keys or [])]
    df = cleaning.impute_median(df, numbers) if profile.median_impute else cleaning.impute_zero(df, numbers)
    df = cleaning.impute_text(df, profile.categorical_fill, [c for c in string_columns(df) if c not in (keys or [])])
    if profile.outlier_contamination is None:
        return df
    skip = set(keys or []) | ({target} if profile.exclude_target_from_outliers and target else set())
    cols = [c for c in numeric_columns(df) if c not in skip]
    return isolation.remove_outliers(
        df, cols, profile.outlier_contamination, profile.outlier_min_rows, keys, profile.seed
    )


def normality_line(norm: DataFrame, numeric: Sequence[str]) -> str:
    """The report line about the first numeric predictor."""
    if not numeric:
        return "No numeric input to test."
    row = norm.where(F.col("column") == numeric[0]).first()
    if row is None or row["test"] == "not enough data":
        return "Too few values to test normality."
    return f"{numeric[0]}: normality p = {row['p_value']:.4f}, use {row['test']}"


def audit(
    df: DataFrame,
    name: str = "dataset",
    profile: AuditProfile = AUDIT,
    keys: Sequence[str] | None = None,
) -> AuditResult:
    """Run the whole audit on one table.

    ``keys`` name columns that identify a row; samples and splits then do not
    depend on how the table is partitioned.  They are not used as predictors.
    """
    spark = df.sparkSession
    if not df.columns or not df.limit(1).count():
        return _stop(spark, name, "FAILED", "The table has no rows")
    found = analyse_structure(df, profile, held=keys or ())
    if found.target is None:
        return _stop(spark, name, "SKIPPED", "No column can serve as the target")
    target, predictors = found.target, found.predictors
    data = materialize(found.df, "prepared")
    rows_in = data.count()
    numeric = [c for c in numeric_columns(data) if c in predictors]
    norm, _ = small_table(
        hypothesis.normality(data, numeric, keys, profile.normality_rows, profile.normality_alpha, profile.seed))
    line = normality_line(norm, numeric)
    kept, removed = leakage.hunt(data, target, predictors, profile, keys)
    common = {"target": target, "rows_in": rows_in, "normality": line, "arrested": len(removed)}
    if not kept:
        return _stop(spark, name, "FAILED", "Every predictor gives the target away or none is left", **common)
    cleaned = materialize(heal(data, profile, target, keys), "cleaned")
    rows = cleaned.count()
    if not rows:
        return _stop(spark, name, "FAILED", "No row is left after the outlier step", rows_removed=rows_in, **common)
    kept = [p for p in kept if p in cleaned.columns]
    labels = target_labels(cleaned, target)
    inputs = profile_features(cleaned, kept, profile)
    if len(labels) < 2 or not inputs:
        return _stop(spark, name, "ERROR", "Target has one class or no input is left", rows_removed=rows_in - rows, **common)
    table = modelling.model_table(cleaned, target, labels, inputs, keys, profile.seed)
    fitted = modelling.fit_and_score(table, len(labels), profile)
    scored = materialize(fitted.scored, "scored")
    tables: dict[str, DataFrame] = {"normality": norm}
    ece = None
    if len(labels) == 2:
        pairs = scored.select("label", F.col("prob")[1].alias("prob"))
        auc = metrics.auc(pairs, "label", "prob").first()["auc"]
        if pairs.limit(1).count():
            tables["calibration"], _ = small_table(metrics.calibration_curve(pairs, "label", "prob"))
            ece = metrics.calibration_error(tables["calibration"]).first()["ece"]
    elif profile.multiclass_auc is not None:
        auc = profile.multiclass_auc
    else:
        probs = [F.col("prob")[i].alias(f"p{i}") for i in range(len(labels))]
        wide = scored.select("label", *probs)
        auc = metrics.auc_macro(wide, "label", [f"p{i}" for i in range(len(labels))]).first()["auc"]
    importances = modelling.importance_table(spark, inputs, fitted.importances)
    top = modelling.top_features(importances, profile.top_features)
    tables["importances"] = importances
    tables["network"] = chartdata.feature_network(top, target, profile.network_edge_scale, profile.network_node_scale)
    tables["scored"] = scored
    tables["leakage"] = spark.createDataFrame(removed, "column string, reason string, measure double")
    reason = f"AUC {auc:.3f}" if auc is not None else "AUC undefined"
    if profile.outlier_contamination is not None and rows_in <= profile.outlier_min_rows:
        reason += f"; outlier step skipped, {rows_in} rows (more than {profile.outlier_min_rows} needed)"
    report = _report(
        spark, name, "SUCCESS", reason, auc=auc, rows_removed=rows_in - rows, predictors=len(kept),
        calibration=fitted.calibration, ece=ece, **common,
    )
    return AuditResult(report, log_rows(spark, [(name, "SUCCESS", reason)]), target, cleaned, tables)


def chart_tables(result: AuditResult, profile: AuditProfile = AUDIT, bins: int = 20) -> dict[str, DataFrame]:
    """Histogram, violin and density tables of the most important columns."""
    if result.cleaned is None:
        return {}
    top = modelling.top_features(result.tables["importances"], profile.top_features).select("source").collect()
    sources = list(dict.fromkeys(r["source"] for r in top))
    numbers = [c for c in numeric_columns(result.cleaned) if c in sources]
    texts = [c for c in string_columns(result.cleaned) if c in sources]
    out: dict[str, DataFrame] = {}
    if numbers:
        out["histogram"] = chartdata.histogram(result.cleaned, numbers, bins, result.target)
        out["violin"] = chartdata.violin_stats(result.cleaned, numbers, result.target)
        out["density"] = chartdata.density_curve(result.cleaned, numbers, result.target, extend=0.0)
    if texts:
        out["counts"] = chartdata.count_by_class(result.cleaned, texts, result.target)
    return out


def audit_many(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    profile: AuditProfile = AUDIT,
    try_fusion: bool = True,
    keys: Mapping[str, Sequence[str]] | None = None,
) -> tuple[dict[str, AuditResult], DataFrame]:
    """Audit several tables, fused first if two of them share a key.

    ``keys`` names the columns that identify a row, per table.  Every input
    has a log row: the two that were fused say into what, the others are
    audited on their own.  A failing table is logged and does not stop the
    others.
    """
    work = dict(tables)
    results: dict[str, AuditResult] = {}
    joined: list[tuple[str, str, str]] = []
    if try_fusion and len(work) > 1:
        fused = fuse_first_pair(work)
        if fused is not None:
            table, name, parts = fused
            work = {name: table, **{n: df for n, df in work.items() if n not in parts}}
            joined = [(n, "FUSED", f"Part of {name}") for n in parts]
    log = log_rows(spark, joined) if joined else spark.createDataFrame([], LOG_SCHEMA)
    for name, df in work.items():
        try:
            results[name] = audit(df, name, profile, (keys or {}).get(name))
        except Exception as err:  # noqa: BLE001 - one bad table must not end the batch
            results[name] = _stop(spark, name, "ERROR", str(err))
        log = log.unionByName(results[name].log)
    return results, log
