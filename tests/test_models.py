import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabaudit.config import AUDIT, DESKTOP, AuditProfile
from tabaudit.operators import encoding, isolation, leakage, metrics, modelling
from tabaudit.plans.audit import audit, audit_many, chart_tables
from tabaudit.plans.critique import critique
from tabaudit.plans.research import report_lines, research
from tabaudit.plans.results import findings_of, results
from tabaudit.sources.sinks import manifest, report_text


def _auc(pdf):
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


@pytest.mark.parametrize("small", [True, False])
def test_auc_with_ties(spark, small):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"s": rng.integers(0, 12, 500) / 10.0, "y": rng.integers(0, 2, 500)})
    assert metrics.auc(spark.createDataFrame(pdf), "y", "s", small).first()["auc"] == pytest.approx(_auc(pdf))


def test_auc_extremes(spark):
    df = spark.createDataFrame([(0, 0.1, 0.9, 0.5), (0, 0.2, 0.8, 0.5), (1, 0.7, 0.3, 0.5), (1, 0.9, 0.1, 0.5)], "y int, up double, down double, flat double")
    assert [metrics.auc(df, "y", c).first()["auc"] for c in ("up", "down", "flat")] == [1.0, 0.0, 0.5]
    assert metrics.auc(df.where("y = 1"), "y", "up").first()["auc"] is None


def test_macro_auc(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.dirichlet([1, 1, 1], 300), columns=["p0", "p1", "p2"])
    pdf["y"] = rng.integers(0, 3, 300)
    want = np.mean([_auc(pd.DataFrame({"s": pdf[f"p{i}"], "y": (pdf.y == i).astype(int)})) for i in range(3)])
    assert metrics.auc_macro(spark.createDataFrame(pdf), "y", ["p0", "p1", "p2"]).first()["auc"] == pytest.approx(want)


def test_calibration_curve(spark):
    rng = np.random.default_rng(2)
    p = rng.random(1000).round(2)
    y = (rng.random(1000) < p).astype(int)
    curve = metrics.calibration_curve(spark.createDataFrame(pd.DataFrame({"p": p, "y": y})), "y", "p").orderBy("bin").collect()
    edges = np.quantile(p, np.linspace(0, 1, 21))
    ids = np.searchsorted(edges[1:-1], p)
    assert [r["bin"] for r in curve] == sorted(set(ids))
    for r in curve:
        assert r["mean_predicted"] == pytest.approx(p[ids == r["bin"]].mean())
        assert r["fraction_positive"] == pytest.approx(y[ids == r["bin"]].mean())
    assert metrics.calibration_bins(100) == 10 and metrics.calibration_bins(800) == 16 and metrics.calibration_bins(10**9) == 20


# --- isolation forest --------------------------------------------------------


def test_planted_outliers_are_removed(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(2000, 3)), rng.choice([-12.0, 12.0], size=(100, 3))])
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf.insert(0, "id", range(len(pdf)))
    df = spark.createDataFrame(pdf)
    kept = isolation.remove_outliers(df, ["a", "b", "c"], keys=["id"])
    gone = set(pdf.id) - {r["id"] for r in kept.collect()}
    assert 80 <= len(gone) <= 130
    assert len([i for i in gone if i >= 2000]) >= 95
    again = isolation.remove_outliers(df.repartition(9), ["a", "b", "c"], keys=["id"])
    assert {r["id"] for r in again.collect()} == {r["id"] for r in kept.collect()}


def test_small_or_textual_tables_pass(spark):
    small = spark.range(500).select(F.col("id").cast("double").alias("x"))
    assert isolation.remove_outliers(small).count() == 500
    words = spark.range(900).select(F.col("id").cast("string").alias("w"))
    assert isolation.remove_outliers(words).count() == 900


def test_tree_layout_gives_the_same_paths():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(256, 2))
    nodes = isolation.grow_tree(x, np.random.default_rng(1), 8)
    frame = pd.DataFrame([(0, *n) for n in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    feature, threshold, path = isolation.lay_out(frame, 1, 8)
    forest = isolation.IsolationForest(["a", "b"], 8, feature, threshold, path, isolation.expected_path(256))
    by_id = {n[0]: n for n in nodes}
    for row in x[:50]:
        n = by_id[0]
        while n[1] >= 0:
            n = by_id[n[3] if row[n[1]] <= n[2] else n[4]]
        want = 2.0 ** (-n[5] / forest.norm)
        assert forest.score_array(row[None, :])[0] == pytest.approx(want)


# --- models ------------------------------------------------------------------


def _signal(spark, n=2500, classes=2, noise=False):
    """Four equally strong predictors: none of them alone looks like a leak."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({
        "key": range(n), "age_years": rng.normal(50, 10, n), "weight": rng.normal(70, 9, n), "dose_a": rng.normal(size=n),
        "dose_b": rng.normal(size=n), "kind_of": rng.choice(list("uvw"), n),
    })
    z = (pdf.age_years - 50) / 10 + (pdf.weight - 70) / 9 + pdf.dose_a + pdf.dose_b + rng.normal(0, 0.3, n)
    if noise:
        z = rng.normal(size=n)
    pdf["target"] = pd.qcut(z, classes, labels=False) if classes > 2 else (z > 0.5).astype(int)
    pdf.loc[::50, "weight"] = np.nan
    return spark.createDataFrame(pdf)


def test_audit_finds_the_signal(spark):
    out = audit(_signal(spark), "signal", keys=["key"])
    r = out.report.first()
    assert (r["status"], r["target"], r["calibration"]) == ("SUCCESS", "target", "prefit")
    assert r["auc"] > 0.9 and r["ece"] < 0.15
    assert 0.03 < r["rows_removed"] / r["rows_in"] < 0.07
    top = {x["source"] for x in modelling.top_features(out.tables["importances"], 4).collect()}
    assert top == {"age_years", "weight", "dose_a", "dose_b"}, "names with an underscore keep their column"
    lines = [x["line"] for x in report_text(out.report).orderBy("line_no").collect()]
    assert lines[0] == "# AUDIT: signal" and lines[2].startswith("AUC: 0.9")
    charts = chart_tables(out)
    assert {"histogram", "violin", "density", "counts"} == set(charts)
    assert charts["counts"].count() == 6
    again = audit(_signal(spark), "signal", keys=["key"]).report.first()
    assert again["auc"] == pytest.approx(r["auc"], abs=1e-12)


def test_noise_has_no_auc(spark):
    assert 0.4 < audit(_signal(spark, noise=True), keys=["key"]).report.first()["auc"] < 0.6


def test_three_classes_and_desktop_profile(spark):
    df = _signal(spark, classes=3)
    assert audit(df, keys=["key"]).report.first()["auc"] > 0.85
    assert audit(df.drop("key").withColumn("target", F.col("target") * 10), profile=DESKTOP).report.first()["auc"] == 0.5


def test_fold_calibration_when_held_out_rows_lack_a_class(spark):
    df = _signal(spark, 600).withColumn("label", F.col("target").cast("double")).withColumn("u", F.rand(1))
    df = df.withColumn("label", F.when(F.col("u").between(0.6, 0.7), 0.0).otherwise(F.col("label")))
    from pyspark.ml.feature import VectorAssembler
    table = VectorAssembler(inputCols=["age_years"], outputCol="features").transform(df).select("label", "u", "features")
    fitted = modelling.fit_and_score(table, 2, AuditProfile(trees=5, depth=3))
    assert fitted.calibration == "folds" and len(fitted.models) == 3
    assert fitted.scored.select(F.max(F.col("prob")[1])).first()[0] <= 1.0


def test_skipped_outlier_step_is_recorded(spark):
    small = audit(_signal(spark, 400), "small", keys=["key"])
    said = "outlier step skipped, 400 rows (more than 500 needed)"
    r, logged = small.report.first(), small.log.collect()
    assert r["rows_removed"] == 0 and r["reason"].endswith(said) and [x["reason"] for x in logged] == [r["reason"]]
    large = audit(_signal(spark, 600), "large", keys=["key"]).report.first()
    assert large["rows_removed"] > 0 and "skipped" not in large["reason"]


def test_early_exits(spark):
    empty = spark.createDataFrame([], "a int, target int")
    assert audit(empty).report.first()["reason"] == "The table has no rows"
    none = spark.range(100).select("id", F.col("id").alias("id2"))
    assert audit(none).report.first()["status"] == "SKIPPED"
    leak = spark.range(200).select((F.col("id") % 2).cast("double").alias("copy"), (F.col("id") % 2).alias("target"))
    r = audit(leak).report.first()
    assert (r["status"], r["arrested"]) == ("FAILED", 1)


def test_hunt(spark):
    df = _signal(spark).withColumn("near", F.col("target") + F.col("age_years") / 10_000).withColumn(
        "echo", F.when(F.col("target") == 1, "yes").otherwise("no"))
    kept, removed = leakage.hunt(df, "target", ["age_years", "weight", "dose_a", "kind_of", "near", "echo"], AUDIT, ["key"])
    assert {r[0]: r[1] for r in removed} == {"near": "correlation", "echo": "importance"}
    assert kept == ["age_years", "weight", "dose_a", "kind_of"]


def test_batch_goes_on_after_a_failure(spark):
    tables = {"good": _signal(spark).drop("key"), "empty": spark.createDataFrame([], "a int"), "odd": spark.createDataFrame([([1],)], "v array<int>")}
    found, log = audit_many(spark, tables, try_fusion=False)
    status = {r["file"]: r["status"] for r in log.collect()}
    assert status["good"] == "SUCCESS" and status["empty"] == "FAILED" and status["odd"] in ("SKIPPED", "ERROR")
    assert manifest(log).first()["status"] == "completed_with_errors" and set(found) == set(tables)


def test_research_and_results(spark):
    df = _signal(spark).drop("key").withColumn("flag", F.col("weight") > 70)
    df = df.withColumn("age_years", F.floor("age_years"))
    found = research(df.select("age_years", "kind_of", "flag", "target").where("kind_of <> 'w'"), "s")
    rows = {r["column"]: r for r in found.predictors.collect()}
    assert found.outcome == "target" and found.auc > 0.7
    assert rows["age_years"]["test"] == "T-Test" and rows["kind_of"]["test"] == "Chi2"
    assert rows["age_years"]["significance"] == "***"
    assert report_lines(found).count() == 3 + found.predictors.count()
    tables = results(df.withColumnRenamed("weight", "BMI").withColumn("SleepHours", F.col("age_years") * 1.0).withColumn("Sex", F.col("kind_of")))
    assert {"t_test", "chi_square", "summary", "figure_box", "figure_pairs", "figure_counts", "figure_correlation"} <= set(tables)
    sig = {r["column"] for r in findings_of(tables["t_test"]).collect()}
    assert "age_years" in sig
    assert any(r["line"].startswith("age_years".ljust(31) + "T-Test") for r in tables["summary"].collect())


def test_split_and_scale(spark):
    df = spark.range(4000)
    parts = {r["part"]: r["count"] for r in encoding.hash_split(df, ["id"]).groupBy("part").count().collect()}
    assert abs(parts["train"] - 2400) < 150 and abs(parts["calibrate"] - 400) < 80
    row = encoding.standard_scale(df.select(F.col("id").cast("double").alias("x"), F.lit(3.0).alias("c")), ["x", "c"]).agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("c").alias("c")).first()
    assert (row["m"], row["s"], row["c"]) == (pytest.approx(0, abs=1e-9), pytest.approx(1), 0.0)


def test_critique(spark, data):
    tables = {n: spark.read.parquet(f"{data}/{n}.parquet") for n in ("nation", "region")}
    found = critique(tables)
    assert {r["dataset"] for r in found.collect()} == {"nation", "region"}


def test_the_cut_is_the_quantile_of_all_scores(spark):
    """A third of the rows are equal; up to ties 5% of all rows go, with or without keys."""
    df = spark.range(30_000).select("id", *[
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.randn(i)).alias(c) for i, c in enumerate("ab")])
    for keys in (["id"], None):
        scored = isolation.outlier_scores(df, ["a", "b"], keys=keys)
        assert scored.where("is_outlier").count() == pytest.approx(1500, abs=5)
        cut = scored.agg(F.max(F.when(~F.col("is_outlier"), F.col("anomaly_score"))).alias("low"),
                         F.min(F.when(F.col("is_outlier"), F.col("anomaly_score"))).alias("high")).first()
        assert cut["low"] < cut["high"]


def test_every_input_of_a_batch_has_a_log_row(spark):
    left = spark.range(40).select("id", (F.col("id") * 2.0).alias("x"))
    right = spark.range(40).select("id", (F.col("id") % 2).alias("target"))
    other = spark.range(30).select((F.col("id") * 7 + 1000).alias("w"), F.lit("a").alias("t"))
    _, log = audit_many(spark, {"left": left, "right": right, "other": other})
    status = {r["file"]: r["status"] for r in log.collect()}
    assert status["left"] == status["right"] == "FUSED" and status["other"] == "SKIPPED" and len(status) == 4
