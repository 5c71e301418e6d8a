import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabaudit.operators import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one value; groups of very different size."""
    rng = np.random.default_rng(3)
    n = 6000
    x = np.where(np.arange(n) % 3 == 0, 7.5, rng.normal(10, 4, n).round(3))
    g = np.where(np.arange(n) < 5000, "big", np.where(np.arange(n) < 5990, "mid", "tiny"))
    pdf = pd.DataFrame({"g": g, "x": x, "y": rng.exponential(5, n)})
    pdf.loc[::17, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf)


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def _expected(pdf, by):
    out = {}
    groups = pdf.groupby(by) if by else [((), pdf)]
    for key, part in groups:
        for c in ("x", "y"):
            v = part[c].dropna()
            out[(key if by else None, c)] = (len(v), np.quantile(v, PROBS))
    return out


@pytest.mark.parametrize("by", [None, "g"])
@pytest.mark.parametrize("method", ["direct", "distributed"])
@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_match_numpy(skewed, by, method, parts):
    pdf, df = skewed
    got = scale.exact_quantiles(df.repartition(parts), ["x", "y"], PROBS, by=[by] if by else [], method=method).collect()
    want = _expected(pdf, by)
    assert len(got) == len(want)
    for r in got:
        n, q = want[(r["g"] if by else None, r["column"])]
        assert r["n"] == n
        np.testing.assert_allclose(r["q"], q, rtol=1e-12)


@pytest.mark.parametrize("by", [None, "g"])
def test_quantiles_with_brackets(skewed, by, monkeypatch):
    """Small sketches make brackets that hold a part of the values only."""
    pdf, df = skewed
    monkeypatch.setattr(scale, "SKETCH_VALUES", 64)
    got = scale.exact_quantiles(df, ["x", "y"], PROBS, by=[by] if by else [], method="distributed").collect()
    want = _expected(pdf, by)
    for r in got:
        np.testing.assert_allclose(r["q"], want[(r["g"] if by else None, r["column"])][1], rtol=1e-12)


def test_missed_bracket_is_settled_over_all_values(skewed, spark, monkeypatch):
    pdf, df = skewed

    def wrong(sketches, probs, by):
        rows = [(c, 100, *[1e9, 1e9] * len(probs)) for c in ("x", "y")]
        names = [f"_{e}{j} double" for j in range(len(probs)) for e in ("lo", "hi")]
        return spark.createDataFrame(rows, "column string, n long, " + ", ".join(names))

    monkeypatch.setattr(scale, "_brackets", wrong)
    got = {r["column"]: r["q"] for r in scale.exact_quantiles(df, ["x", "y"], [0.5], method="distributed").collect()}
    assert got["x"][0] == pytest.approx(np.median(pdf.x))
    assert got["y"][0] == pytest.approx(np.nanmedian(pdf.y))


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("buckets", [1, 4, 17])
def test_running_totals(spark, small, buckets):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900), "o": rng.integers(0, 400, 900), "n": 1})
    pdf = pdf.groupby(["g", "o"], dropna=False, as_index=False)["n"].sum()
    df = spark.createDataFrame(pdf.astype({"n": "int64"}))
    df = df.withColumn("g", F.when(F.col("g") != "NaN", F.col("g")))
    out = scale.running_totals(df, "o", ["n"], ["g"], small=small, buckets=buckets).toPandas()
    assert len(out) == len(pdf)
    for _, part in out.groupby(out.g.fillna("-")):
        part = part.sort_values("o")
        assert (part.n_before.to_numpy() == part.n.cumsum().shift(fill_value=0).to_numpy()).all()
        assert (part.n_total == part.n.sum()).all()


def test_hash_levels_are_few_and_ordered(spark):
    rows = spark.range(200_000).select(scale.unit_hash("id").alias("h")).withColumn("lvl", scale.hash_level(F.col("h")))
    span = rows.groupBy("lvl").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).orderBy("lvl").collect()
    # A level per row or so would make every task of a large table count millions of groups.
    assert len(span) < 400 and sum(r["n"] for r in span) == 200_000
    assert all(a["high"] < b["low"] for a, b in zip(span, span[1:]))
    ends = spark.createDataFrame([(0.0,), (1 - 2.0**-32,)], "h double").select(scale.hash_level(F.col("h"))).collect()
    assert [r[0] for r in ends] == [-528, -1]


@pytest.mark.parametrize("n", [1, 7, 250, 999])
def test_smallest_by_hash_by_brute_force(spark, n):
    df = spark.range(3000).select("id", F.when(F.col("id") < 20, "few").otherwise(F.concat(F.lit("g"), F.col("id") % 2)).alias("g"))
    rows = df.withColumn("h", scale.unit_hash("id", salt=42)).collect()
    want = {r["id"] for r in sorted(rows, key=lambda r: (r["h"], r["id"]))[:n]}
    assert {r["id"] for r in scale.smallest_by_hash(df, n, ["id"]).collect()} == want
    want = {(g, r["id"]) for g in ("few", "g0", "g1") for r in sorted((r for r in rows if r["g"] == g), key=lambda r: (r["h"], r["id"]))[:n]}
    given = df.withColumn("own", scale.unit_hash("id", salt=42))
    for got in (scale.smallest_by_hash(df, n, ["id"], ["g"]), scale.smallest_by_hash(given, n, ["id"], ["g"], hashed="own")):
        assert {(r["g"], r["id"]) for r in got.collect()} == want


def test_smallest_by_hash_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    first = {r["id"] for r in scale.smallest_by_hash(df.repartition(1), 100, ["id"]).collect()}
    second = {r["id"] for r in scale.smallest_by_hash(df.repartition(13), 100, ["id"]).collect()}
    assert first == second and len(first) == 100
    grouped = scale.smallest_by_hash(df.repartition(7), 40, ["id"], by=["g"]).groupBy("g").count().collect()
    assert sorted(r["count"] for r in grouped) == [40, 40, 40]
    assert scale.smallest_by_hash(df, 10_000, ["id"]).count() == 5000
    assert scale.smallest_by_hash(df.where("id < 0"), 10, ["id"]).count() == 0


def test_join_with_hot_and_missing_keys(spark):
    big = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 500).alias("k"))
    one = spark.createDataFrame([(i, f"v{i}") for i in range(500)] + [(None, "none")], "u long, v string")
    out = scale.split_hot_keys(big, one, "k", "u")
    assert out.columns == ["id", "k", "u", "v"]
    assert out.count() == 9000 == out.select("id").distinct().count()
    assert out.where("k is null and v = 'none'").count() == 3000


def test_materialize_uses_the_shared_folder(spark):
    df = scale.materialize(spark.range(10), "probe")
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert df.count() == 10


def test_small_table_limit(spark):
    table, rows = scale.small_table(spark.range(50), limit=100)
    assert len(rows) == 50 and table.count() == 50
    table, rows = scale.small_table(spark.range(50), limit=10)
    assert rows is None and table.count() == 50
