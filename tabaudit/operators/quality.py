"""Rule-based quality findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.config import QualityRules
from tabaudit.functions.columns import col, number, numeric_columns, pearson, string_columns
from tabaudit.operators.profiling import distinct_and_rows, duplicate_rows, iqr_outliers, null_counts

ISSUE, WARNING = "issue", "warning"


def _finding(name: str, check: str, column: Column, severity: Column, metric: str, value: Column, message: Column) -> list[Column]:
    return [
        F.lit(name).alias("dataset"), F.lit(check).alias("check"), column.cast("string").alias("column"),
        severity.alias("severity"), F.lit(metric).alias("metric"), value.cast("double").alias("value"),
        message.alias("message"),
    ]


def size_findings(df: DataFrame, name: str, rules: QualityRules = QualityRules()) -> DataFrame:
    """Too few rows, too many columns, missing cells: all from one pass."""
    first, width = df.columns[0], len(df.columns)
    pct = F.col("null_pct")
    severe = pct > rules.missing_issue
    gap_text = F.when(severe, F.format_string("%s: more than half empty, %.1f%% without a value", "column", "null_pct")).otherwise(
        F.format_string("%s: %.1f%% without a value", "column", "null_pct")
    )
    # The counts have one row per column; table-wide rules ride on the first.
    once = F.col("column") == first
    nobody = F.lit(None)
    cases = [
        (once & (F.col("total") < rules.min_rows),
         _finding(name, "shape", nobody, F.lit(WARNING), "rows", F.col("total"),
                  F.format_string("only %d rows, too few for firm statistics", "total"))),
        (once & F.lit(width > rules.max_columns),
         _finding(name, "shape", nobody, F.lit(WARNING), "columns", F.lit(width),
                  F.format_string("%d columns, more than can be judged one by one", F.lit(width)))),
        (pct > rules.missing_warning,
         _finding(name, "missing", F.col("column"), F.when(severe, ISSUE).otherwise(WARNING), "null_pct", pct, gap_text)),
    ]
    found = F.filter(F.array(*[F.when(cond, F.struct(*fields)) for cond, fields in cases]), lambda x: x.isNotNull())
    return null_counts(df).select(F.inline(found))


def shape_findings(df: DataFrame, name: str, rules: QualityRules = QualityRules()) -> DataFrame:
    return size_findings(df, name, rules).where(F.col("check") == "shape")


def missing_findings(df: DataFrame, name: str, rules: QualityRules = QualityRules()) -> DataFrame:
    return size_findings(df, name, rules).where(F.col("check") == "missing")


def duplicate_findings(df: DataFrame, name: str, rules: QualityRules = QualityRules()) -> DataFrame:
    pct = F.try_divide(F.col("duplicate_rows").cast("double"), F.col("total_rows")) * 100
    return duplicate_rows(df).where("duplicate_rows > 0").withColumn("_p", pct).select(
        *_finding(name, "duplicates", F.lit(None), F.when(F.col("_p") > rules.duplicate_issue, ISSUE).otherwise(WARNING),
                  "duplicate_pct", F.col("_p"), F.format_string("%d rows repeat another one (%.1f%%)", "duplicate_rows", "_p"))
    )


def outlier_findings(df: DataFrame, name: str, rules: QualityRules = QualityRules()) -> DataFrame:
    pct = F.col("outlier_pct")
    return iqr_outliers(df).where(pct > rules.outlier_warning).select(
        *_finding(name, "outliers", F.col("column"), F.when(pct > rules.outlier_issue, ISSUE).otherwise(WARNING),
                  "outlier_pct", pct,
                  F.format_string("%s: %d values beyond the fences (%.1f%%)", "column", "outliers", "outlier_pct"))
    )


def target_correlations(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """(column, r) of every numeric column with a numeric target, one pass."""
    cols = cols if cols is not None else numeric_columns(df, exclude=[target])
    return correlations_with(df, number(target), cols)


def correlations_with(df: DataFrame, y: Column, cols: list[str]) -> DataFrame:
    """(column, r) of numeric columns with one numeric expression."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, r double")
    long = df.select(y.alias("_y"), *[number(c).alias(c) for c in cols]).unpivot(
        ["_y"], [col(c) for c in cols], "column", "value"
    )
    return long.groupBy("column").agg(pearson(F.col("value"), F.col("_y")).alias("r"))


def leakage_findings(df: DataFrame, name: str, rules: QualityRules = QualityRules()) -> DataFrame | None:
    if rules.target not in numeric_columns(df):
        return None
    r = F.abs("r")
    severe = r > rules.leak_issue
    text = F.when(
        severe, F.format_string("%s: almost a copy of the target, |r| = %.4f", F.col("column"), r)
    ).otherwise(F.format_string("%s: may give the target away, |r| = %.4f", F.col("column"), r))
    return target_correlations(df, rules.target).where(r > rules.leak_warning).select(
        *_finding(name, "leakage", F.col("column"), F.when(severe, ISSUE).otherwise(WARNING), "abs_r", r, text)
    )


def type_findings(df: DataFrame, name: str, rules: QualityRules = QualityRules()) -> DataFrame | None:
    cols = string_columns(df)
    if not cols:
        return None
    return distinct_and_rows(df, cols).where(F.col("distinct_count") > F.col("rows") * rules.distinct_share).select(
        *_finding(name, "types", F.col("column"), F.lit(WARNING), "distinct_count", F.col("distinct_count"),
                  F.format_string("%s: text with %d different values, over half as many as rows", "column", "distinct_count"))
    )


def findings(df: DataFrame, name: str = "dataset", rules: QualityRules = QualityRules()) -> DataFrame:
    """All rules as rows (dataset, check, column, severity, metric, value, message)."""
    out = None
    for rule in (size_findings, duplicate_findings, outlier_findings, leakage_findings, type_findings):
        part = rule(df, name, rules)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


def summary(found: DataFrame) -> DataFrame:
    """Issues and warnings per dataset."""
    return found.groupBy("dataset").agg(
        F.count_if(F.col("severity") == ISSUE).alias("issues"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
    )


def report_lines(found: DataFrame) -> DataFrame:
    """One text line per finding, issues first."""
    rank = F.when(F.col("severity") == ISSUE, 0).otherwise(1)
    return found.select(
        "dataset", rank.alias("rank"), F.concat(F.upper("severity"), F.lit(": "), F.col("message")).alias("line")
    )
