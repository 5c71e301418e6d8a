"""Random forest, Platt calibration, importances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.config import AuditProfile
from tabaudit.functions.columns import col
from tabaudit.operators.encoding import Feature, code_expression, split_column
from tabaudit.operators.scale import materialize


def model_table(
    df: DataFrame, target: str, labels: Sequence[str], inputs: Sequence[Feature],
    keys: Sequence[str] | None = None, seed: int = 42,
) -> DataFrame:
    """(label, u, features), written once so that every fit reads the same rows."""
    names = [f"f{i}" for i in range(len(inputs))]
    flat = df.select(
        code_expression(col(target), labels).alias("label"), split_column(keys, seed).alias("u"),
        *[f.value.alias(n) for n, f in zip(names, inputs)],
    )
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(flat).select("label", "u", "features")
    if keys:
        # Forests depend on row order: place and order rows by their key hash.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        vec = vec.repartition(parts, "u").sortWithinPartitions("u")
    return materialize(vec, "model")


def fit_forest(train: DataFrame, trees: int, depth: int, seed: int = 42) -> RandomForestClassificationModel:
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxMemoryInMB=512
    ).fit(train)


def with_probability(model: RandomForestClassificationModel, df: DataFrame, out: str = "prob") -> DataFrame:
    """Class probabilities as an array column."""
    return model.transform(df).withColumn(out, vector_to_array("probability")).drop(
        "rawPrediction", "probability", "prediction"
    )


def fit_platt(scored: DataFrame, prob: str = "p", label: str = "label") -> LogisticRegressionModel:
    """Sigmoid of the model probability with smoothed targets.

    Every row enters once as positive with weight t and once as negative with
    weight 1 - t, t being the smoothed target of its class.
    """
    scored = materialize(scored, "platt")  # the fit reads it many times
    row = scored.agg(F.count_if(col(label) == 1).alias("p"), F.count_if(col(label) == 0).alias("n")).first()
    if not row["p"] or not row["n"]:
        raise ValueError("calibration rows need both classes")
    hi, lo = (row["p"] + 1.0) / (row["p"] + 2.0), 1.0 / (row["n"] + 2.0)
    t = F.when(col(label) == 1, F.lit(hi)).otherwise(F.lit(lo))
    both = scored.select(
        col(prob).alias("x"),
        F.inline(F.array(
            F.struct(F.lit(1.0).alias("label"), t.alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (F.lit(1.0) - t).alias("weight")),
        )),
    )
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(both)
    return LogisticRegression(weightCol="weight", regParam=0.0, maxIter=100).fit(vec)


def platt_probability(model: LogisticRegressionModel, x):
    a, b = float(model.coefficients[0]), float(model.intercept)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * x + F.lit(b))))


@dataclass
class Fitted:
    """Outcome of the modelling step."""

    scored: DataFrame            # label, prob (array) on the evaluation rows
    importances: list[float]
    calibration: str             # prefit | folds | none
    models: list[RandomForestClassificationModel]


def _mean(vectors: list[list[float]]) -> list[float]:
    return [sum(v) / len(vectors) for v in zip(*vectors)]


def fit_and_score(table: DataFrame, classes: int, profile: AuditProfile) -> Fitted:
    """Train on the first share, calibrate on the second, score the third.

    Calibration falls back from the held-out rows to three folds over the
    training and calibration rows, then to none.
    """
    train_share, cal_share, _ = profile.split
    u = F.col("u")
    train = table.where(u < train_share)
    held = table.where((u >= train_share) & (u < train_share + cal_share))
    test = table if profile.in_sample_auc else table.where(u >= train_share + cal_share)
    forest = fit_forest(train, profile.trees, profile.depth, profile.seed)
    plain = Fitted(with_probability(forest, test).select("label", "prob"), list(forest.featureImportances.toArray()), "none", [forest])
    if classes != 2 or not profile.calibrate:
        return plain

    def as_pair(p):
        return F.array(F.lit(1.0) - p, p).alias("prob")

    try:
        cal = with_probability(forest, held).select("label", F.col("prob")[1].alias("p"))
        platt = fit_platt(cal)
        scored = plain.scored.select("label", as_pair(platt_probability(platt, F.col("prob")[1])))
        return Fitted(scored, plain.importances, "prefit", [forest])
    except ValueError:
        pass
    try:
        return _fit_folds(table, test, train_share + cal_share, profile)
    except ValueError:
        return plain


def _fit_folds(table: DataFrame, test: DataFrame, share: float, profile: AuditProfile, folds: int = 3) -> Fitted:
    """Each fold calibrates a forest grown on the others; probabilities are averaged."""
    pool = table.where(F.col("u") < share)
    fold = F.floor(F.col("u") / F.lit(share) * folds)
    scored, models = test.withColumn("_sum", F.lit(0.0)), []
    for k in range(folds):
        forest = fit_forest(pool.where(fold != k), profile.trees, profile.depth, profile.seed)
        cal = with_probability(forest, pool.where(fold == k)).select("label", F.col("prob")[1].alias("p"))
        platt = fit_platt(cal)
        scored = with_probability(forest, scored, "_p").withColumn(
            "_sum", F.col("_sum") + platt_probability(platt, F.col("_p")[1])
        ).drop("_p")
        models.append(forest)
    p = F.col("_sum") / F.lit(float(folds))
    return Fitted(
        scored.select("label", F.array(F.lit(1.0) - p, p).alias("prob")),
        _mean([list(m.featureImportances.toArray()) for m in models]), "folds", models,
    )


def importance_table(spark, inputs: Sequence[Feature], importances: Sequence[float]) -> DataFrame:
    """(feature, source, importance), one row per model input."""
    rows = [(f.name, f.source, float(v)) for f, v in zip(inputs, importances)]
    return spark.createDataFrame(rows, "feature string, source string, importance double")


def top_features(importances: DataFrame, k: int) -> DataFrame:
    """The k most important inputs, ties by name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
