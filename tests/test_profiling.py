import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabaudit.config import QualityRules
from tabaudit.operators import chartdata, evidence, profiling, quality


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({
        "a": rng.normal(0, 1, n), "b": rng.integers(0, 9, n).astype(float), "c": np.ones(n),
        "t": rng.choice(["x", "y", "z"], n),
    })
    pdf["d"] = pdf.a * 2 + rng.normal(0, 0.1, n)
    pdf.loc[::7, "b"] = np.nan
    pdf["void"] = np.nan
    df = spark.createDataFrame(pdf)
    return pdf, df


def test_describe(frame):
    pdf, df = frame
    got = {r["column"]: r for r in profiling.describe(df).collect()}
    assert set(got) == {"a", "b", "c", "d"}, "a column without values is left out"
    for c in ("a", "b", "d"):
        v = pdf[c].dropna()
        r = got[c]
        assert (r["n"], r["null_count"]) == (len(v), len(pdf) - len(v))
        for name, want in (("mean", v.mean()), ("median", v.median()), ("std", v.std()), ("q25", v.quantile(0.25)), ("q75", v.quantile(0.75))):
            assert r[name] == pytest.approx(want, rel=1e-9), (c, name)
        z = (v - v.mean()) / v.std(ddof=0)
        assert r["skewness"] == pytest.approx((z**3).mean(), abs=1e-9)
        assert r["kurtosis"] == pytest.approx((z**4).mean() - 3, abs=1e-9)
    assert got["c"]["skewness"] is None or math.isnan(got["c"]["skewness"])


def test_correlation_forms_agree(frame):
    pdf, df = frame
    cols = ["a", "b", "c", "d"]
    want = pdf[cols].corr()
    for pairs in (profiling._pairs_as_aggregates(df, cols), profiling._pairs_by_tiles(df.repartition(3), cols, 256, 1 << 26)):
        rows = pairs.collect()
        assert len(rows) == 6
        for r in rows:
            w = want.loc[r["var1"], r["var2"]]
            if np.isnan(w):
                assert r["r"] is None
            else:
                assert r["r"] == pytest.approx(w, abs=1e-10)
    high = profiling.high_correlations(df, cols).collect()
    assert [(r["var1"], r["var2"]) for r in high] == [("a", "d")]
    assert profiling.correlation_pairs(df, ["a"]).count() == 0


def test_nulls_and_overview(frame):
    pdf, df = frame
    got = {r["column"]: r["nulls"] for r in profiling.null_counts(df).collect()}
    assert got == pdf.isnull().sum().to_dict()
    row = profiling.overview(df.union(df.limit(5))).first()
    assert (row["total_rows"], row["duplicate_rows"], row["total_columns"]) == (405, 5, 6)


@pytest.mark.parametrize("method", ["direct", "hashed"])
def test_duplicates_with_many_copies(spark, method):
    df = spark.range(900).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    r = profiling.duplicate_rows(df, method).first()
    assert (r["total_rows"], r["distinct_rows"], r["duplicate_rows"]) == (900, 602, 298)


def test_categories_ties_and_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string").withColumn("e", F.lit(None).cast("string"))
    got = {r["column"]: r for r in profiling.categorical_profile(df).collect()}
    assert (got["v"]["unique_values"], got["v"]["most_common"], got["v"]["most_common_count"], got["v"]["null_count"]) == (2, "a", 2, 1)
    assert (got["e"]["unique_values"], got["e"]["most_common"], got["e"]["most_common_count"]) == (0, None, 0)


def test_small_distinct_counts_large_path(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 7).alias("few"), F.col("id").alias("many"))
    monkeypatch.setattr(profiling, "is_small", lambda d: False)
    found = profiling.small_distinct_counts(df, ["few", "many"], 10)
    assert found["few"] == 7 and found["many"] > 1000


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert profiling.describe(df).count() == 0
    assert profiling.duplicate_rows(df).first()["duplicate_rows"] == 0
    assert profiling.null_totals(df).first()["null_percentage"] is None
    assert chartdata.histogram(df, ["x"]).count() == 0


# --- quality ---------------------------------------------------------------


def _problematic(spark):
    rng = np.random.default_rng(5)
    n = 100
    a, b = rng.normal(0, 1, n), rng.normal(0, 0.1, n)
    target = rng.integers(0, 2, n)
    a[::10] = np.nan
    b[::15] = 999.0
    return spark.createDataFrame(pd.DataFrame({"feature_a": a, "feature_b": b, "target": target, "feature_c": target}))


def test_problematic_table(spark):
    rows = quality.findings(_problematic(spark), "bad").collect()
    leaks = [r for r in rows if r["check"] == "leakage"]
    assert [(r["column"], r["severity"]) for r in leaks] == [("feature_c", "issue")]
    assert not [r for r in rows if r["check"] == "missing"], "10% missing is below the limit"
    out = [r for r in rows if r["check"] == "outliers" and r["column"] == "feature_b"]
    assert len(out) == 1 and out[0]["value"] >= 7


def test_outlier_share_of_exactly_two_percent_is_no_finding(spark):
    pdf = pd.DataFrame({"amount": np.tile([1.0, 2.0, 3.0, 4.0], 50), "is_fraud": [1.0] * 4 + [0.0] * 196})
    rows = quality.findings(spark.createDataFrame(pdf), "fraud").collect()
    assert not [r for r in rows if r["check"] == "outliers"]


def test_small_and_wide_tables(spark):
    wide = spark.createDataFrame([tuple(range(101))], ", ".join(f"c{i} int" for i in range(101)))
    checks = {(r["check"], r["metric"]) for r in quality.shape_findings(wide, "w").collect()}
    assert checks == {("shape", "rows"), ("shape", "columns")}


def test_messages_and_summary(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x")] * 20, "k string, v string")
    found = quality.findings(df, "t", QualityRules())
    facts = {(r["check"], r["column"], r["severity"], r["metric"], round(r["value"], 1)) for r in found.collect()}
    assert facts == {("missing", "v", "issue", "null_pct", 66.7), ("duplicates", None, "issue", "duplicate_pct", 96.7)}
    lines = [r["line"] for r in quality.report_lines(found).collect()]
    assert len(lines) == 2 and all(x.startswith("ISSUE: ") for x in lines)
    assert any("58" in x and "96.7%" in x for x in lines) and any(x.startswith("ISSUE: v: ") and "66.7%" in x for x in lines)
    row = quality.summary(found).first()
    assert (row["issues"], row["warnings"]) == (2, 0)


def test_bias_score_is_clamped(spark):
    sizes = spark.createDataFrame([("a", 10, 4, 0, 40)], "table string, rows long, cols long, missing long, cells long")
    assert evidence.rollup(sizes).first()["potential_bias"] == 5.0
    sizes = spark.createDataFrame([("a", 10, 4, 39, 40)], "table string, rows long, cols long, missing long, cells long")
    assert evidence.rollup(sizes).first()["potential_bias"] == 45.0


# --- chart data --------------------------------------------------------------


def test_histogram_matches_numpy(frame):
    pdf, df = frame
    rows = chartdata.histogram(df, ["a", "b", "c"], 15).collect()
    for c in ("a", "b", "c"):
        want, edges = np.histogram(pdf[c].dropna(), bins=15)
        got = np.zeros(15, dtype=int)
        for r in rows:
            if r["column"] == c:
                got[r["bin"]] = r["n"]
                assert r["low"] == pytest.approx(edges[r["bin"]], abs=1e-9)
        assert got.tolist() == want.tolist()


def test_density_is_close_to_the_exact_kernel(frame):
    pdf, df = frame
    v = pdf.a.to_numpy()
    rows = chartdata.density_curve(df, ["a"], points=50).orderBy("point").collect()
    x = np.array([r["x"] for r in rows])
    h = v.std(ddof=1) * len(v) ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose([r["density"] for r in rows], want, atol=1e-5)


def test_box_whiskers(spark):
    df = spark.createDataFrame([("k", float(v)) for v in [1, 2, 3, 4, 5, 100]], "t string, x double")
    r = chartdata.box_stats(df, ["x"], "t").first()
    assert (r["whisker_low"], r["whisker_high"], r["outliers"], r["median"]) == (1.0, 5.0, 1, 3.5)


@pytest.mark.parametrize("block, held", [(256, 1 << 26), (7, 1 << 26), (7, 4000), (1, 1)])
def test_correlation_in_tiles(spark, block, held):
    rng = np.random.default_rng(block)
    n, k = 400, 17
    x = rng.normal(size=(n, k)).cumsum(1) + 1e5
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:, 3] = 4.0
    x[:, 5] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i:02d}" for i in range(k)])
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r["var1"], r["var2"]): (r["n"], r["r"]) for r in profiling.correlation_pairs(df, block=block, held=held).collect()}
    assert len(got) == k * (k - 1) // 2
    want = pdf.corr()
    for (a, b), (m, r) in got.items():
        assert a < b and m == int((pdf[a].notna() & pdf[b].notna()).sum())
        if "c03" in (a, b) or "c05" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_tiles_bound_a_task():
    groups = profiling._tiles(5000, 256, 64 * 1024 * 1024)
    pairs = [(i, j) for g in profiling._tiles(23, 4, 2000) for rows, cols in g for i in rows for j in cols if i < j]
    assert sorted(pairs) == [(i, j) for i in range(23) for j in range(i + 1, 23)]
    assert all(sum(48 * len(r) * len(c) for r, c in g) <= 64 * 1024 * 1024 for g in groups) and len(groups) < 20
