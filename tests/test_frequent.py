"""Most frequent values by bounded summaries and digests against plain counting."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.operators import frequent, profiling, quality


def _top(rows, cols, k):
    out = set()
    for j, c in enumerate(cols):
        counts = collections.Counter(r[j] for r in rows if r[j] is not None)
        for place, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((c, v, n, place))
    return out


@pytest.mark.parametrize("kept", [4, 30, 4096])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_values(spark, kept, k):
    rng = random.Random(kept * 100 + k)
    long = "same beginning of more than thirty-two characters "
    make = {
        "hot": lambda i: "x" if i % 3 == 0 else f"v{rng.randrange(500)}",
        "zipf": lambda i: f"z{int(rng.paretovariate(1))}",
        "all": lambda i: f"{long}{i:05d}",
        "tied": lambda i: long + "abcdefgh"[i % 8],
        "none": lambda i: None,
        "odd": lambda i: rng.choice([None, "", " ", "é", "Z", "a"]),
    }
    rows = [tuple(f(i) for f in make.values()) for i in range(2000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in make)).repartition(5)
    got = [tuple(r) for r in frequent.top_values(df, k=k, kept=kept).collect()]
    assert set(got) == _top(rows, list(make), k) and len(got) == len(set(got))


def test_summaries_miss_no_more_than_they_say():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 5, 3000), rng.integers(0, 10_000, 7000)])
    rng.shuffle(keys)
    s = frequent._Summary(50)
    for part in np.array_split(keys, 30):
        s.add(part)
    true = collections.Counter(keys.tolist())
    held = dict(zip(s.keys.tolist(), s.counts.tolist()))
    assert s.cells == 10_000 and s.missed <= 10_000 / 51 and len(held) <= 50
    assert all(held.get(v, 0) <= n <= held.get(v, 0) + s.missed for v, n in true.items())
    assert set(range(5)) <= set(held)


def test_clear_columns_need_no_digests(spark, monkeypatch):
    monkeypatch.setattr(frequent, "value_digests", None)
    df = spark.createDataFrame([("a" if i % 2 else f"v{i}",) for i in range(5000)], "c string").repartition(4)
    assert [tuple(r) for r in frequent.top_values(df, k=1, kept=64).collect()] == [("c", "a", 2500, 1)]


def test_numbers_and_empty_tables(spark):
    df = spark.createDataFrame([(1.5, 1), (0.0, 2), (-0.0, 2), (float("nan"), None), (None, 2)], "x double, n int")
    assert {tuple(r) for r in frequent.top_values(df, k=1).collect()} == {("x", "0.0", 2, 1), ("n", "2", 3, 1)}
    assert frequent.top_values(df.limit(0)).isEmpty() and frequent.top_values(df, []).isEmpty() and frequent.top_values(df, k=0).isEmpty()


def test_digested_profile_equals_direct(spark):
    rows = [(None if i % 7 == 0 else f"t{i % 11}", f"u{i}" * 20, None, "") for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c string, `d.e` string").repartition(3)
    plain = lambda method: sorted(map(tuple, profiling.categorical_profile(df, method=method).collect()))
    assert plain("digested") == plain("direct")
    assert profiling.categorical_profile(df.limit(0), method="digested").count() == profiling.categorical_profile(df.limit(0), method="direct").count()


def test_large_tables_count_digests(spark, monkeypatch):
    df = spark.createDataFrame([(i % 5, f"w{i}") for i in range(100)] + [(None, None)], "n int, t string")
    direct = {tuple(r) for r in profiling.distinct_counts(df).collect()}
    monkeypatch.setattr(profiling, "is_small", lambda *a: False)
    monkeypatch.setattr(profiling, "value_counts", None)
    assert {tuple(r) for r in profiling.distinct_counts(df).collect()} == direct == {("n", 5), ("t", 100)}
    assert [(r["column"], r["value"]) for r in quality.type_findings(df, "x").collect()] == [("t", 100.0)]
