"""Hypothesis tests: normality, two-class t, chi-square, one-way F, Kruskal-Wallis."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col, number, numeric_columns, significance, string_columns
from tabaudit.functions.special import chi2_pvalue, f_pvalue, francia_pvalue, normal_quantile, shapiro_wilk, t_pvalue
from tabaudit.operators.scale import BROADCAST_ROWS, materialize, running_totals, smallest_by_hash, unit_hash, unpivot_numeric


def first_labels(df: DataFrame, target: str, n: int = 2) -> list[str]:
    """The first ``n`` class labels in text order; missing classes are ignored."""
    labels = df.select(col(target).cast("string").alias("c")).where("c is not null").distinct()
    return [r["c"] for r in labels.orderBy("c").limit(n).collect()]


def t_test(df: DataFrame, target: str, cols: Sequence[str] | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """Pooled two-sample t-test of the first two classes, all columns in one pass.

    (column, n0, n1, mean0, mean1, t, dof); NULLs are left out per column.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[target])
    labels = list(labels) if labels is not None else first_labels(df, target)
    first, second = (labels + [None, None])[:2]
    long = unpivot_numeric(
        df.select(col(target).cast("string").alias("class"), *[number(c).alias(c) for c in cols]), cols, ["class"]
    )
    aggs = []
    for k, label in enumerate((first, second)):
        x = F.when(F.col("class") == F.lit(label), F.col("value"))
        aggs += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"mean{k}"), F.var_samp(x).alias(f"var{k}")]
    wide = long.where(F.col("class").isin(first, second)).groupBy("column").agg(*aggs)
    dof = F.col("n0") + F.col("n1") - F.lit(2)
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    pooled = F.try_divide((n0 - 1) * F.coalesce("var0", F.lit(0.0)) + (n1 - 1) * F.coalesce("var1", F.lit(0.0)), dof)
    scale = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n0) + F.try_divide(F.lit(1.0), n1)))
    return wide.select(
        "column", "n0", "n1", "mean0", "mean1",
        F.try_divide(F.col("mean0") - F.col("mean1"), scale).alias("t"), dof.alias("dof"),
    )


def with_t_pvalue(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", t_pvalue(F.col("t"), F.col("dof"))).withColumn(
        "significance", significance(F.coalesce("p_value", F.lit(1.0)))
    )


def crosstab(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(column, value, class, n); rows with a missing value or class are left out."""
    cols = list(cols)
    long = df.select(
        col(target).cast("string").alias("class"), *[col(c).cast("string").alias(c) for c in cols]
    ).unpivot(["class"], [col(c) for c in cols], "column", "value")
    return (
        long.where("value is not null and class is not null")
        .groupBy("column", "value", "class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi_square(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, chi2, dof) of value x class independence.

    Sums (O - E)^2 / E over the cells that exist; an empty cell adds its E, and
    all of those together are N less the E of the cells that exist.  No term
    is a difference of large numbers.  2x2 tables take Yates' continuity
    correction.
    """
    cols = list(cols) if cols is not None else string_columns(df, exclude=[target])
    # The table is read once; everything below works on the written cell counts.
    return chi_square_of_cells(materialize(crosstab(df, cols, target), "cells"))


def chi_square_of_cells(cells: DataFrame) -> DataFrame:
    """The test on counted cells (column, value, class, n)."""
    # Marginals grow with distinct values and classes, never with rows.
    by_class = cells.groupBy("column", "class").agg(F.sum("n").alias("_c"))
    by_value = cells.groupBy("column", "value").agg(F.sum("n").alias("_r"))
    totals = by_class.groupBy("column").agg(F.sum("_c").alias("_n"))
    expected = F.col("_r").cast("double") * (F.col("_c") / F.col("_n"))
    parts = (
        cells.join(by_value, ["column", "value"])
        .join(by_class, ["column", "class"])
        .join(totals, "column")
        .groupBy("column")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.pow(F.col("n") - expected, F.lit(2)) / expected).alias("_s"),
            F.sum(expected).alias("_e"),
            F.count(F.lit(1)).alias("_cells"),
            F.min(F.struct("_r", "_c", "n")).alias("_one"),
        )
    )
    values = by_value.groupBy("column").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.lit(1.0) / F.col("_r")).alias("_inv_r")
    )
    classes = by_class.groupBy("column").agg(
        F.count(F.lit(1)).alias("_cols"), F.sum(F.lit(1.0) / F.col("_c")).alias("_inv_c")
    )
    t = parts.join(values, "column").join(classes, "column")
    dof = (F.col("_rows") - 1) * (F.col("_cols") - 1)
    every = F.col("_cells") == F.col("_rows") * F.col("_cols")
    plain = F.col("_s") + F.when(every, F.lit(0.0)).otherwise(F.col("n") - F.col("_e"))
    # In a 2x2 table |O - E| is the same in all four cells.
    gap = F.abs(F.col("_one.n") - F.col("_one._r").cast("double") * (F.col("_one._c") / F.col("n")))
    gap = gap - F.least(F.lit(0.5), gap)
    yates = gap * gap * F.col("n") * F.col("_inv_r") * F.col("_inv_c")
    stat = F.when(dof == 0, F.lit(0.0)).when(dof == 1, yates).otherwise(plain)
    return t.select("column", "n", stat.alias("chi2"), dof.alias("dof"))


def with_chi2_pvalue(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", chi2_pvalue(F.col("chi2"), F.col("dof"))).withColumn(
        "significance", significance(F.coalesce("p_value", F.lit(1.0)))
    )


def anova(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """One-way F test: (column, n, groups, f, df_between, df_within)."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[target])
    x = F.col("value")
    classes = materialize(
        unpivot_numeric(
            df.where(col(target).isNotNull()).select(
                col(target).cast("string").alias("class"), *[number(c).alias(c) for c in cols]
            ), cols, ["class"],
        )
        .groupBy("column", "class")
        .agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("ss")),
        "classes",
    )
    grand = classes.groupBy("column").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    stats = (
        classes.join(grand, "column")
        .groupBy("column")
        .agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("ss").alias("_within"),
            F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2))).alias("_between"),
        )
    )
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.try_divide(F.try_divide(F.col("_between"), d1), F.try_divide(F.col("_within"), d2))
    return stats.select("column", "n", "groups", f.alias("f"), d1.alias("df_between"), d2.alias("df_within"))


def with_f_pvalue(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", f_pvalue(F.col("f"), F.col("df_between"), F.col("df_within")))


def kruskal(df: DataFrame, target: str, cols: Sequence[str] | None = None, small: bool | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction: (column, n, groups, h, dof).

    Values are counted per class first; ranks come from running totals over
    distinct values, ties sharing their average rank.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[target])
    source = df.where(col(target).isNotNull()).select(col(target).cast("string").alias("class"), *[number(c).alias(c) for c in cols])
    cells = materialize(
        unpivot_numeric(source, cols, ["class"]).groupBy("column", "value", "class").agg(F.count(F.lit(1)).alias("_n")),
        "cells",
    )
    values = cells.groupBy("column", "value").agg(F.sum("_n").alias("cnt"))
    ranked = materialize(running_totals(values, "value", ["cnt"], ["column"], small=small), "ranks")
    # Ranks less n / 2: the middle is 1/2, so H needs no difference of large numbers.
    rank = F.col("cnt_before") - F.col("cnt_total") / F.lit(2.0) + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
    cnt = F.col("cnt").cast("double")
    ties = ranked.groupBy("column").agg(
        F.max("cnt_total").alias("n"), F.sum(cnt * cnt * cnt - cnt).alias("_ties")
    )
    sums = (
        cells.join(ranked.select("column", "value", rank.alias("_rank")), ["column", "value"])
        .groupBy("column", "class")
        .agg(F.sum(F.col("_n") * F.col("_rank")).alias("_r"), F.sum("_n").alias("_c"))
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum(F.col("_c") * F.pow(F.col("_r") / F.col("_c") - F.lit(0.5), F.lit(2))).alias("_s"),
        )
    )
    n = F.col("n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("_s")
    fix = F.lit(1.0) - F.try_divide(F.col("_ties"), n * n * n - n)
    return sums.join(ties, "column").select(
        "column", "n", "groups", F.try_divide(h, fix).alias("h"), (F.col("groups") - 1).alias("dof")
    )


def with_h_pvalue(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", chi2_pvalue(F.col("h"), F.col("dof")))


def normality_sample(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] | None = None, rows: int = 500, seed: int = 42
) -> DataFrame:
    """(column, value): up to ``rows`` present values of every column by key hash."""
    key = F.concat_ws("|", *[col(k).cast("string") for k in keys]) if keys else F.monotonically_increasing_id().cast("string")
    # One digest of a row serves all its columns.
    base = df.select(key.alias("_key"), *[number(c).alias(c) for c in cols]).withColumn("_hash", unit_hash("_key", salt=seed))
    picked = smallest_by_hash(unpivot_numeric(base, cols, ["_key", "_hash"]), rows, ["_key"], ["column"], hashed="_hash")
    return picked.select("column", "value")


def normal_score_fit(df: DataFrame, cols: Sequence[str], small: bool | None = None) -> DataFrame:
    """(column, n, w): Shapiro-Francia W of all present values of each column.

    W is the squared correlation of the values with their normal scores, the
    normal quantiles of (rank - 3/8) / (n + 1/4); equal values share their
    average rank.  Values are counted first and ranks are running totals over
    the counts, so neither a column nor a hot value is one task's work.  A
    column of one value has W = 1, a column with infinite values has none.
    """
    cells = materialize(
        unpivot_numeric(df.select(*[number(c).alias(c) for c in cols]), list(cols))
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")), "values",
    )
    # Deviations from the mean keep digits when the mean is far from zero; one row per column.
    means = cells.groupBy("column").agg((F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("_mean"))
    ranked = running_totals(cells, "value", ["cnt"], ["column"], small=small)
    rank = F.col("cnt_before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
    share = (rank - F.lit(0.375)) / (F.col("cnt_total") + F.lit(0.25))
    x, m, c = F.col("value") - F.col("_mean"), F.col("_m"), F.col("cnt")
    sums = ranked.withColumn("_p", share).withColumn("_m", normal_quantile("_p")).join(F.broadcast(means) if len(cols) <= BROADCAST_ROWS else means, "column").groupBy("column").agg(
        F.max("cnt_total").alias("n"), F.count(F.lit(1)).alias("_values"), F.sum(c * x * m).alias("_xm"),
        F.sum(c * x * x).alias("_xx"), F.sum(c * m * m).alias("_mm"), F.sum(c * m).alias("_sm"), F.sum(c * x).alias("_sx"),
    )
    n = F.col("n")
    xm = F.col("_xm") - F.col("_sx") * F.col("_sm") / n
    xx, mm = F.col("_xx") - F.col("_sx") * F.col("_sx") / n, F.col("_mm") - F.col("_sm") * F.col("_sm") / n
    w = F.when(F.col("_values") == 1, F.lit(1.0)).otherwise(F.try_divide(xm * xm, xx * mm))
    return sums.select("column", "n", F.when(~F.isnan(w), F.least(w, F.lit(1.0))).alias("w"))


def normality(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] | None = None,
    rows: int = 500,
    alpha: float = 0.05,
    seed: int = 42,
    small: bool | None = None,
) -> DataFrame:
    """Is a column normal?  (column, position, n, w, p_value, test, sampled, sample_w, sample_p).

    ``w``, ``p_value`` and the named ``test`` come from all present values
    (Shapiro-Francia).  Shapiro-Wilk on a hash sample of ``rows`` values is
    reported beside it; it decides only where all values are three or four,
    for which the other has no p-value.  Fewer values, or none, name no test.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    schema = (
        "column string, position int, n bigint, w double, p_value double, test string, sampled bigint, sample_w double, sample_p double"
    )
    if not cols:
        return df.sparkSession.createDataFrame([], schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "sampled": [len(pdf)], "sample_w": [w], "sample_p": [p]})

    # One row per column on either side.
    sampled = (
        normality_sample(df, cols, keys, rows, seed).groupBy("column")
        .applyInPandas(one, "column string, sampled bigint, sample_w double, sample_p double")
    )
    present = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("sample_w", "sample_p")]
    fit = normal_score_fit(df, cols, small).join(sampled.select("column", "sampled", *present), "column", "left")
    few = F.col("n") < 5
    p = F.when(few, F.col("sample_p")).when(F.col("w") >= 1.0, F.lit(1.0)).otherwise(francia_pvalue(F.col("w"), F.col("n")))
    name = F.when((F.col("n") < 3) | F.col("p_value").isNull(), "not enough data").when(F.col("p_value") > alpha, "ANOVA")
    place = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)]), F.col("column"))
    return fit.withColumn("p_value", p).select(
        "column", place.alias("position"), "n", "w", "p_value", name.otherwise("Kruskal-Wallis").alias("test"),
        "sampled", "sample_w", "sample_p",
    )


def recommended_tests(df: DataFrame, target: str, norm: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Run for each column the test that the normality check names, and no other.

    (column, test, statistic, p_value); a column without a named test has no row.
    """
    # One row per column.
    named = {r["column"]: r["test"] for r in norm.select("column", "test").collect()}
    runs = []
    if by_f := [c for c in cols if named.get(c) == "ANOVA"]:
        runs.append(with_f_pvalue(anova(df, target, by_f)).select("column", F.lit("ANOVA").alias("test"), F.col("f").alias("statistic"), "p_value"))
    if by_rank := [c for c in cols if named.get(c) == "Kruskal-Wallis"]:
        runs.append(with_h_pvalue(kruskal(df, target, by_rank)).select("column", F.lit("Kruskal-Wallis").alias("test"), F.col("h").alias("statistic"), "p_value"))
    if not runs:
        return df.sparkSession.createDataFrame([], "column string, test string, statistic double, p_value double")
    return runs[0] if len(runs) == 1 else runs[0].unionByName(runs[1])
