import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabaudit.config import SOURCE_TEXT_RULES, TextRule
from tabaudit.operators import fusion, textscan


def _frame(spark, name, values, extra="v"):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, {extra} int")


def test_overlap_must_exceed_the_threshold(spark):
    left = _frame(spark, "a", [f"k{i}" for i in range(10)], "n1")
    six = _frame(spark, "b", [f"k{i}" for i in range(6)] + ["x", "y", "z", "w"], "n2")
    seven = _frame(spark, "b", [f"k{i}" for i in range(7)] + ["x", "y", "z"], "n2")
    names = [("a", "b")]
    pairs = lambda r: [(x["column1"], x["column2"], x["common"]) for x in fusion.key_candidates({"l": left.select("a"), "r": r.select("b")}).collect()]
    assert pairs(six) == []
    assert pairs(seven) == [("a", "b", 7)] and names


def test_few_values_are_no_key(spark):
    t = {"l": _frame(spark, "a", list("abcd")).select("a"), "r": _frame(spark, "b", list("abcd")).select("b")}
    assert fusion.key_candidates(t).count() == 0
    assert fusion.auto_fuse(t) is None


def test_repeated_keys_on_both_sides_do_not_fuse(spark):
    twice = [f"k{i}" for i in range(8)] * 2
    left, right = _frame(spark, "a", twice).select("a"), _frame(spark, "b", twice).select("b")
    assert fusion.auto_fuse({"l": left, "r": right}) is None
    fused, name = fusion.auto_fuse({"left": left, "rightmost": right.distinct()})
    assert fused.count() == 16 and name == "FUSED_left_right.csv"


def test_missing_keys_match_and_names_get_suffixes(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    out = fusion.fuse(left, right, "k", "k")
    assert out.columns == ["k", "v_x", "v_y"]
    assert sorted((r["v_x"], r["v_y"]) for r in out.collect()) == [(1, 10), (2, 20), (3, 20)]
    other = fusion.fuse(left.withColumnRenamed("k", "p"), right, "p", "k")
    assert other.columns == ["p", "v_x", "k", "v_y"]


def test_keys_of_different_types(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "a long, s string")
    right = spark.createDataFrame([("1", 5), ("7", 6)], "b string, t int")
    assert [tuple(r) for r in fusion.fuse(left, right, "a", "b").collect()] == [(1, "x", "1", 5)]


def test_heads_look_at_first_rows_only(spark):
    left = _frame(spark, "a", [f"k{i}" for i in range(50)]).select("a").coalesce(1)
    right = _frame(spark, "b", [f"q{i}" for i in range(25)] + [f"k{i}" for i in range(25)]).select("b").coalesce(1)
    assert fusion.key_candidates({"l": left, "r": right}, threshold=0.4).count() == 1
    assert fusion.key_candidates({"l": left, "r": right}, threshold=0.4, heads=10).count() == 0


def _pairs_by_force(tables, threshold):
    out = set()
    for i, (t1, (cols1, rows1)) in enumerate(tables):
        for t2, (cols2, rows2) in tables[i + 1 :]:
            for j, a in enumerate(cols1):
                for k, b in enumerate(cols2):
                    x, y = ({r[n] for r in rows if r[n] is not None} for n, rows in ((j, rows1), (k, rows2)))
                    if min(len(x), len(y)) >= 5 and len(x & y) > threshold * min(len(x), len(y)):
                        out.add((t1, a, t2, b, len(x), len(y), len(x & y)))
    return out


@pytest.mark.parametrize("kept, side_rows", [(4096, 100_000), (64, 100_000), (64, 3), (8, 100_000)])
def test_sketched_pairs_equal_all_pairs(spark, monkeypatch, kept, side_rows):
    table = fusion.small_table
    monkeypatch.setattr(fusion, "small_table", lambda df: table(df, side_rows))
    rng = random.Random(kept)
    key = lambda i: f"k{i}"
    sizes = [3, 6, 40, 300, 2000]
    tables = []
    for t in range(3):
        rows = 2500
        cols = []
        for c in range(4):
            size, base, step = rng.choice(sizes), rng.choice([0, 0, 100, 5000]), rng.choice([1, 1, 2])
            values = [key(base + step * rng.randrange(size)) for _ in range(rows)]
            cols.append([v if rng.random() > 0.05 else rng.choice([None, "", v]) for v in values])
        tables.append((f"t{t}", ([f"c{t}{i}" for i in range(4)], list(zip(*cols)))))
    frames = {n: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).repartition(3) for n, (cols, rows) in tables}
    got = {tuple(r)[:7] for r in fusion.key_candidates(frames, kept=kept, method="sketched").collect()}
    assert got == _pairs_by_force(tables, 0.6) and got
    if kept == 8:
        assert {tuple(r)[:7] for r in fusion.key_candidates(frames, method="direct").collect()} == got


def test_only_cells_of_possible_pairs_are_compared(spark, monkeypatch):
    written = {}
    write = fusion.materialize

    def spy(df, name):
        out = write(df, name)
        written[name] = out
        return out

    monkeypatch.setattr(fusion, "materialize", spy)
    big = spark.range(40_000).select((F.col("id") * 3).alias("a"), F.concat(F.lit("text "), "id").alias("b"))
    small = spark.range(50).select((F.col("id") * 6).alias("k"), F.concat(F.lit("other "), "id").alias("w"))
    got = fusion.key_candidates({"big": big, "small": small}, kept=256, method="sketched").collect()
    assert [tuple(r)[:7] for r in got] == [("big", "a", "small", "k", 40_000, 50, 50)]
    # Of the large column only the fifty values that were asked for.
    assert written["values"].count() == 150
    assert written["sketch"].count() < 3_000
    other = spark.range(40_000).select((F.col("id") * 3 + 1).alias("z"))
    assert fusion.key_candidates({"big": big.select("a"), "other": other}, kept=256, method="sketched").isEmpty()
    assert fusion.key_candidates({"none": big.limit(0), "small": small}, method="sketched").isEmpty() and fusion.key_candidates({"small": small}).isEmpty()


# --- text scan against Python's regular expressions -------------------------

_RULES = SOURCE_TEXT_RULES + (TextRule("gap", r"\n\s*\n", "LOW"),)


def _expected(text):
    out = set()
    for r in _RULES:
        for i, m in enumerate(re.finditer(r.pattern, text)):
            out.add((r.name, i, text[: m.start()].count("\n") + 1, m.group(0)[:50]))
    return out


def _scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [set() for _ in texts]
    for r in textscan.scan(df, "k", "t", _RULES).collect():
        got[r["k"]].add((r["rule"], r["match_no"], r["line"], r["code"]))
    return got


def test_many_matches_in_one_text(spark):
    rng = random.Random(2)
    parts = ["except:", "\n", "x", " ", "'/usr/lib/a'", "\n\n", "if x > 12", "except\n :"]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (1, 2, 3, 5, 17, 400, 20_000)]
    assert _scan(spark, texts) == [_expected(t) for t in texts]


def test_scan_of_source_text(spark):
    text = (
        "p = '/usr/lib/x.y'\ntry:\n    print('a')\nexcept:\n    pass\n\n\n"
        "if  n > 100:\n  print(\"/tmp/" + "z" * 80 + "\")\nif a\n == 42: except\n :\n"
    )
    assert _scan(spark, [text, "", "nothing here"]) == [_expected(text), set(), set()]
    assert len(_expected(text)) == 9


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["except", ":", "\n", " ", "print(", "if x >", "12", "'/a/b'", "é"]), max_size=25), min_size=1, max_size=6))
def test_scan_matches_python(spark, parts):
    texts = ["".join(p) for p in parts]
    assert _scan(spark, texts) == [_expected(t) for t in texts]


def test_totals_and_first_matches(spark):
    df = spark.createDataFrame([(1, "print(\n" * 7 + "except:"), (2, "x")], "k int, t string")
    totals = {r["severity"]: r["matches"] for r in textscan.totals(df, "k", "t").collect()}
    assert totals == {"LOW": 7, "MEDIUM": 1}
    first = textscan.first_matches(textscan.scan(df, "k", "t"), "k").orderBy("line").collect()
    assert [(r["rule"], r["line"]) for r in first] == [("no_logging", i) for i in (1, 2, 3, 4)] + [("bare_except", 8)]
    assert textscan.rule_table(spark).count() == 4


@pytest.fixture(autouse=True)
def _quiet(spark):
    spark.sparkContext.setLogLevel("ERROR")
