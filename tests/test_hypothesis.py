from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from tabaudit.functions import special
from tabaudit.operators import hypothesis


def test_tails_against_commons_math(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution
    for dof in (1.0, 2.5, 10.0, 357.0, 59998.0):
        d = dist.TDistribution(dof)
        for t in (0.0, 0.3, 1.96, -4.0, 9.0):
            assert special.t_two_sided(t, dof) == pytest.approx(2 * d.cumulativeProbability(-abs(t)), rel=1e-7, abs=1e-14)
    for dof in (1.0, 2.0, 7.0, 120.0):
        d = dist.ChiSquaredDistribution(dof)
        for x in (0.01, 1.0, 3.84, 50.0, 200.0):
            assert special.chi2_sf(x, dof) == pytest.approx(1 - d.cumulativeProbability(x), rel=1e-7, abs=1e-13)
    for d1, d2 in ((1.0, 5.0), (2.0, 300.0), (9.0, 12.0)):
        d = dist.FDistribution(d1, d2)
        for f in (0.1, 1.0, 4.0, 25.0):
            assert special.f_sf(f, d1, d2) == pytest.approx(1 - d.cumulativeProbability(f), rel=1e-7, abs=1e-13)


def test_shapiro_published_example():
    w, p = special.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.78881, abs=1e-4)
    assert p == pytest.approx(0.006704, abs=1e-4)


def test_shapiro_separates_shapes():
    rng = np.random.default_rng(1)
    assert special.shapiro_wilk(rng.normal(size=500))[1] > 0.05
    assert special.shapiro_wilk(rng.exponential(size=500))[1] < 1e-6
    assert np.isnan(special.shapiro_wilk([1.0, 2.0])[0])


def test_t_fixture(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4)] + [(1, float(v)) for v in (2, 4, 6, 8)] + [(0, None), (None, 5.0)], "y int, x double")
    r = hypothesis.with_t_pvalue(hypothesis.t_test(df, "y")).first()
    assert (r["t"], r["dof"], r["n0"], r["n1"]) == (pytest.approx(-1.7320508), 6, 4, 4)
    assert r["p_value"] == pytest.approx(0.13397459621556)
    assert r["significance"] == "ns"


def test_t_of_constant_column(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (0, 1.0), (1, 1.0)], "y int, x double")
    r = hypothesis.with_t_pvalue(hypothesis.t_test(df, "y")).first()
    assert r["t"] is None and r["p_value"] is None and r["significance"] == "ns"


def _table(spark, cells):
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "v string, t string")


def test_chi2_fixture_with_continuity_correction(spark):
    df = _table(spark, {("a", "p"): 10, ("a", "q"): 20, ("b", "p"): 30, ("b", "q"): 5})
    r = hypothesis.with_chi2_pvalue(hypothesis.chi_square(df, "t")).first()
    assert (r["chi2"], r["dof"]) == (pytest.approx(16.578482, abs=1e-6), 1)
    assert r["p_value"] == pytest.approx(4.67e-5, rel=1e-2)


def test_chi2_with_empty_cells(spark):
    cells = {("a", "p"): 8, ("b", "q"): 6, ("c", "p"): 3, ("c", "q"): 3}
    r = hypothesis.chi_square(_table(spark, cells), "t").first()
    o = np.array([[8, 0], [0, 6], [3, 3]], float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert (r["chi2"], r["dof"]) == (pytest.approx(((o - e) ** 2 / e).sum()), 2)
    two = hypothesis.chi_square(_table(spark, {("a", "p"): 4, ("b", "q"): 5}), "t").first()
    assert two["chi2"] == pytest.approx(9 * (20 - 4.5) ** 2 / (4 * 5 * 4 * 5))
    assert hypothesis.chi_square(_table(spark, {("a", "p"): 4, ("a", "q"): 5}), "t").first()["chi2"] == 0.0


@pytest.mark.parametrize("small", [True, False])
def test_kruskal_and_anova_by_brute_force(spark, small):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 300), "x": rng.integers(0, 20, 300).astype(float)})
    pdf["x"] += (pdf.g == "c") * 2
    df = spark.createDataFrame(pdf)
    rank = pdf.x.rank()
    n = len(pdf)
    h = 12 / (n * (n + 1)) * (rank.groupby(pdf.g).sum() ** 2 / pdf.groupby("g").size()).sum() - 3 * (n + 1)
    ties = pdf.x.value_counts()
    h /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    assert hypothesis.kruskal(df, "g", small=small).first()["h"] == pytest.approx(h)
    groups = pdf.groupby("g").x
    between = (groups.size() * (groups.mean() - pdf.x.mean()) ** 2).sum() / 2
    within = ((pdf.x - groups.transform("mean")) ** 2).sum() / (n - 3)
    assert hypothesis.anova(df, "g").first()["f"] == pytest.approx(between / within)


def test_normality_per_column(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(2000), "bell": rng.normal(size=2000), "tail": rng.exponential(size=2000), "few": [1.0, 2.0] + [np.nan] * 1998})
    df = spark.createDataFrame(pdf)
    one = {r["column"]: r for r in hypothesis.normality(df.repartition(3), ["bell", "tail", "few"], ["id"]).collect()}
    two = {r["column"]: r for r in hypothesis.normality(df.repartition(11), ["bell", "tail", "few"], ["id"]).collect()}
    assert one["tail"]["test"] == "Kruskal-Wallis" and one["bell"]["sampled"] == 500
    assert one["few"]["test"] == "not enough data"
    assert one["bell"]["sample_w"] == two["bell"]["sample_w"]
    assert one["bell"]["w"] == pytest.approx(two["bell"]["w"], rel=1e-9)


def test_one_digest_of_a_row_for_all_columns(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "id * 1.5 AS a", "id * 2.5 AS b")
    asked = []
    smallest = hypothesis.smallest_by_hash
    monkeypatch.setattr(hypothesis, "smallest_by_hash", lambda d, *a, **k: asked.append(d) or smallest(d, *a, **k))
    got = hypothesis.normality_sample(df, ["a", "b"], ["id"], rows=40)
    assert {r["column"]: r["count"] for r in got.groupBy("column").count().collect()} == {"a": 40, "b": 40}
    # Printed from the last step down: digests are made below the step that turns columns into rows.
    plan = asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.index("Expand") < plan.index("md5(")


def _francia(x):
    rank = pd.Series(x).rank()
    m = np.array([NormalDist().inv_cdf((r - 0.375) / (len(x) + 0.25)) for r in rank])
    return np.corrcoef(x, m)[0, 1] ** 2


@pytest.mark.parametrize("small", [True, False])
def test_normality_of_all_rows(spark, small):
    rng = np.random.default_rng(8)
    n = 6000
    bell = rng.normal(size=n)
    # One value in forty lies apart: five hundred values often hide it, all rows do not.
    pdf = pd.DataFrame({
        "id": range(n), "bell": bell, "far": np.where(np.arange(n) % 40 == 0, bell * 2.2, bell), "ties": np.round(bell) + 1e9,
        "same": 7.0, "hot": np.where(np.arange(n) % 3 == 0, 0.5, bell), "none": np.nan, "four": [1.0, 2.0, 3.0, 9.0] + [np.nan] * (n - 4), "endless": [np.inf] + [1.0] * (n - 1),
    })
    df = spark.createDataFrame(pdf).repartition(4)
    got = {r["column"]: r for r in hypothesis.normality(df, [c for c in pdf if c != "id"], ["id"], small=small).collect()}
    for c in ("bell", "far", "ties", "hot", "four"):
        x = pdf[c].dropna().to_numpy()
        assert got[c]["n"] == len(x) and got[c]["w"] == pytest.approx(_francia(x), rel=1e-7)
    # A normal column that is only rounded stays normal: equal values share their score.
    assert {c: r["test"] for c, r in got.items()} == {
        "bell": "ANOVA", "far": "Kruskal-Wallis", "ties": "ANOVA", "same": "ANOVA", "hot": "Kruskal-Wallis", "four": "ANOVA", "endless": "not enough data",
    }
    assert got["four"]["p_value"] == got["four"]["sample_p"] and got["same"]["p_value"] == 1.0 and got["far"]["sampled"] == 500


def test_francia_keeps_its_size():
    rng = np.random.default_rng(9)
    for n, times in ((5, 400), (50, 400), (20_000, 60)):
        m = np.array([NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)])
        p = [special.francia_sf(np.corrcoef(np.sort(rng.normal(size=n)), m)[0, 1] ** 2, n) for _ in range(times)]
        assert np.mean(np.array(p) < 0.1) < 0.1 + 3 * np.sqrt(0.09 / times)
    assert np.isnan(special.francia_sf(0.9, 4)) and special.francia_sf(1.0, 10) == 1.0


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.075, 0.3, 0.5, 0.6, 0.925, 0.9251, 0.999999, 1 - 1e-15]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    for r in df.withColumn("q", special.normal_quantile("p")).collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-15)


def test_only_the_named_test_runs(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, float(i), float(i * i)) for i in range(60)], "g int, a double, b double")
    norm = spark.createDataFrame([("a", "ANOVA"), ("b", "Kruskal-Wallis")], "column string, test string")
    ran = {}
    for name in ("anova", "kruskal"):
        run = getattr(hypothesis, name)
        monkeypatch.setattr(hypothesis, name, lambda d, t, cols, run=run, name=name: ran.setdefault(name, cols) and run(d, t, cols))
    got = {r["column"]: r["test"] for r in hypothesis.recommended_tests(df, "g", norm, ["a", "b"]).collect()}
    assert got == {"a": "ANOVA", "b": "Kruskal-Wallis"} and ran == {"anova": ["a"], "kruskal": ["b"]}
    ran.clear()
    assert hypothesis.recommended_tests(df, "g", norm.where("column = 'a'"), ["a", "b"]).count() == 1 and ran == {"anova": ["a"]}
    assert hypothesis.recommended_tests(df, "g", norm.limit(0), ["a", "b"]).isEmpty()


def test_large_counts(spark):
    from fractions import Fraction

    from tabaudit.functions import special

    # Probabilities at 1e13 degrees of freedom are those of the limit.
    assert special.t_two_sided(2.0, 1e13) == pytest.approx(0.04550026389635842, abs=1e-12)
    assert special.f_sf(4.0, 1, 1e13) == pytest.approx(0.04550026389635842, abs=1e-9)
    cells = {("a", "x"): 4_000_000_000, ("a", "y"): 4_000_010_000, ("b", "x"): 4_000_020_000, ("b", "y"): 4_000_000_000, ("c", "x"): 10**13, ("c", "y"): 10**13}
    rows = [("v", v, c, n) for (v, c), n in cells.items()]
    counted = spark.createDataFrame(rows, "column string, value string, class string, n long")
    got = hypothesis.chi_square_of_cells(counted).first()
    total = sum(cells.values())
    r = {v: sum(n for (a, _), n in cells.items() if a == v) for v in "abc"}
    k = {c: sum(n for (_, b), n in cells.items() if b == c) for c in "xy"}
    true = sum((Fraction(n) - Fraction(r[v] * k[c], total)) ** 2 / Fraction(r[v] * k[c], total) for (v, c), n in cells.items())
    assert got["chi2"] == pytest.approx(float(true), rel=1e-6) and got["dof"] == 2
