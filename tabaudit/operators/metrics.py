"""ROC-AUC, multi-class AUC, calibration curve and calibration error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.operators.scale import counted_quantiles, materialize, running_totals


def _auc_from_counts(counts: DataFrame, by: Sequence[str], small: bool | None) -> DataFrame:
    """Tie-aware AUC from (by..., score, pos, neg) counts."""
    ranked = running_totals(counts, "score", ["neg", "pos"], by, small=small)
    area = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    p, n = F.sum("pos"), F.sum("neg")
    return ranked.groupBy(*by).agg(
        p.alias("positives"), n.alias("negatives"),
        F.try_divide(area, p.cast("double") * n.cast("double")).alias("auc"),
    )


def auc(df: DataFrame, label: str, score: str, small: bool | None = None) -> DataFrame:
    """One row (positives, negatives, auc); ``label`` holds 0/1.

    Rows are counted per distinct score before anything is ordered.
    """
    y = col(label)
    counts = (
        df.where(y.isNotNull() & col(score).isNotNull())
        .groupBy(col(score).alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    return _auc_from_counts(counts, [], small)


def auc_per_class(df: DataFrame, label: str, scores: Sequence[str], small: bool | None = None) -> DataFrame:
    """One-vs-rest AUC per class; ``label`` is the index into ``scores``."""
    items = F.array(
        *[
            F.struct(F.lit(i).alias("class"), col(s).alias("score"), (col(label) == i).alias("hit"))
            for i, s in enumerate(scores)
        ]
    )
    counts = (
        df.where(col(label).isNotNull()).select(F.inline(items))
        .groupBy("class", "score")
        .agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )
    return _auc_from_counts(counts, ["class"], small)


def auc_macro(df: DataFrame, label: str, scores: Sequence[str], small: bool | None = None) -> DataFrame:
    return auc_per_class(df, label, scores, small).agg(
        F.count("auc").alias("classes"), F.avg("auc").alias("auc")
    )


def calibration_bins(rows: int) -> int:
    return min(20, max(10, rows // 50))


def calibration_curve(
    df: DataFrame, label: str, prob: str, bins: int | None = None, small: bool | None = None
) -> DataFrame:
    """Quantile-binned reliability curve: (bin, n, mean_predicted, fraction_positive).

    A row's bin is the number of inner edges below its probability; empty
    bins give no row.  The rows are read once and counted per probability;
    edges and bins come from those counts.
    """
    counts = materialize(
        df.where(col(label).isNotNull() & col(prob).isNotNull())
        .groupBy(col(prob).cast("double").alias("p"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum(col(label).cast("double")).alias("hits")),
        "probabilities",
    )
    if bins is None:
        bins = calibration_bins(counts.agg(F.sum("cnt").alias("n")).first()["n"] or 0)
    inner = counted_quantiles(counts, "p", "cnt", [i / bins for i in range(1, bins)], small)
    at = sum(((F.lit(e) < F.col("p")).cast("int") for e in inner), F.lit(0))
    n = F.sum("cnt")
    return counts.groupBy(at.alias("bin")).agg(
        n.alias("n"), (F.sum(F.col("p") * F.col("cnt")) / n).alias("mean_predicted"),
        (F.sum("hits") / n).alias("fraction_positive"),
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    """Expected and maximum calibration error of a curve."""
    gap = F.abs(F.col("mean_predicted") - F.col("fraction_positive"))
    return curve.agg(
        F.sum("n").alias("n"), (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce")
    )
