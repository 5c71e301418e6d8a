"""Every registered query against its SQL on the smallest data."""

import math

import duckdb
import pytest

from tabaudit import queries as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
# Covered by other tests with the same work.
HEAVY = {"calibrated_audit", "research_report", "multiclass_audit"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(rows):
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=_key)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = _plain(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = _plain(tuple(r[i] for i in order) for r in cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, abs=2e-6, rel=1e-9) if isinstance(y, float) else y), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - HEAVY))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_flagship(spark, data):
    row = registry.flagship(spark, data).first()
    assert row["target"] == "quality" and row["status"] == "SUCCESS"
