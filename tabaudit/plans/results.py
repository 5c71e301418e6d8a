"""Two-class statistics and figure tables of one cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.config import FIGURE_CATEGORICAL, FIGURE_NUMERIC
from tabaudit.functions.columns import col, numeric_columns, scalar_columns
from tabaudit.operators import chartdata, hypothesis, profiling
from tabaudit.operators.structure import choose_binary_target
from tabaudit.sources.sinks import stats_lines


def flags_as_numbers(df: DataFrame) -> DataFrame:
    """Booleans count as numbers here."""
    flags = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: col(c).cast("bigint") for c in flags}) if flags else df


def results(df: DataFrame, target: str | None = None, max_numeric: int | None = None, max_text: int | None = None) -> dict[str, DataFrame]:
    """t-tests, chi-square tests and the fixed figure tables.

    All columns are tested unless ``max_numeric`` / ``max_text`` cap them
    (15 and 10 give the classic report).
    """
    df = flags_as_numbers(df)
    names = scalar_columns(df)
    if target is None:
        sizes = profiling.small_distinct_counts(df, names, 2)
        target = choose_binary_target(df.columns, lambda c: sizes.get(c, 0))
    numbers = numeric_columns(df, exclude=[target])[:max_numeric]
    texts = [c for c in names if c not in numeric_columns(df) and c != target][:max_text]
    out: dict[str, DataFrame] = {}
    lines = None
    if numbers:
        out["t_test"] = hypothesis.with_t_pvalue(hypothesis.t_test(df, target, numbers))
        lines = stats_lines(out["t_test"].where("p_value is not null"), "T-Test")
        out["violin"] = chartdata.violin_stats(df, numbers, target)
    if texts:
        out["chi_square"] = hypothesis.with_chi2_pvalue(hypothesis.chi_square(df, target, texts))
        out["counts"] = chartdata.count_by_class(df, texts, target)
        more = stats_lines(out["chi_square"].where("p_value is not null"), "Chi2")
        lines = more if lines is None else lines.unionByName(more)
    if lines is not None:
        out["summary"] = lines
    figures = [c for c in FIGURE_NUMERIC if c in numbers]
    if figures:
        out["figure_histogram"] = chartdata.histogram(df, figures, bins=80)
        out["figure_box"] = chartdata.box_stats(df, figures, target)
    shown = [c for c in FIGURE_CATEGORICAL if c in texts]
    if shown:
        out["figure_counts"] = chartdata.count_by_class(df, shown, target)
    if len(figures) > 1:
        whole = df.dropna("any", subset=[*figures, target])
        out["figure_pairs"] = chartdata.pair_bins(whole, figures, target)
        out["figure_diagonal"] = chartdata.density_curve(whole, figures, target, extend=0.0)
        out["figure_correlation"] = profiling.correlation_matrix(whole, figures)
    return out


def findings_of(tests: DataFrame) -> DataFrame:
    return tests.where(F.col("significance") != "ns")
