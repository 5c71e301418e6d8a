"""States of files merged to those of the table, and the scans a summary takes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabaudit.operators import evidence, profiling, states
from tabaudit.queries import descriptive


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({
        "g": rng.integers(0, 4, n), "x": rng.normal(1e6, 3, n), "hot": np.where(np.arange(n) % 3 == 0, 7.0, rng.exponential(size=n)),
        "same": 2.5, "gap": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 9, n)), "none": np.nan, "t": rng.choice(["a", "b", None], n),
    })
    return spark.createDataFrame(pdf).withColumn("t", F.when(F.col("t") != "NaN", F.col("t"))).withColumn("many", F.array("g"))


NUMBERS = ["g", "x", "hot", "same", "gap", "none"]


def _same(a, b):
    a, b = ({r["column"]: r.asDict() for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys()
    for c in a:
        assert a[c].keys() == b[c].keys()
        for k, v in a[c].items():
            if isinstance(v, float):
                assert v == pytest.approx(b[c][k], rel=1e-6, abs=1e-9, nan_ok=True), (c, k)
            else:
                assert v == b[c][k] or (v is None and np.isnan(b[c][k])), (c, k)


def test_merged_parts_equal_the_whole(table):
    parts = states.column_states(table, by=["g"])
    merged = states.merged_states(parts)
    _same(states.shape_measures(merged), profiling.moments(table, NUMBERS).select("column", "n", "mean", "std", "min", "max", "skewness", "kurtosis", "null_count"))
    rows = {r["column"]: r for r in merged.collect()}
    assert rows["t"]["present"] == table.where("t is not null").count() and rows["t"]["n"] == 0 and rows["many"]["present"] == 3000
    found = {r["column"]: r["distinct_estimate"] for r in states.distinct_estimates(merged).collect()}
    assert found["t"] == 2 and found["none"] == 0 and found["x"] == pytest.approx(3000, rel=0.05) and found["gap"] == 9


def test_described_by_two_scans(spark, table, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    df = spark.read.parquet(path)
    _same(profiling.describe(df, NUMBERS, "distributed"), profiling.describe(df, NUMBERS, "direct"))
    scans = []
    write = profiling.materialize
    monkeypatch.setattr(profiling, "materialize", lambda d, name: scans.append(d) or write(d, name))
    profiling.describe(df, NUMBERS, "distributed")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    # The states are one scan of the table; brackets are the other one.
    assert len(scans) == 1 and plan(scans[0]).count("Relation [") == 1


def test_new_files_alone_are_read(spark, table, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "store")
    table.where("g < 2").coalesce(1).write.parquet(path)
    first = states.file_states(spark, path, store)
    assert first.select("file").distinct().count() == 1
    before = {(r["file"], r["column"]): r["mean"] for r in first.collect()}
    table.where("g >= 2").repartition(2).write.mode("append").parquet(path)
    seen = []
    read = lambda *paths: seen.append(paths) or spark.read.parquet(*paths)
    now = states.file_states(spark, path, store, read=read)
    assert len(seen) == 2 and seen[0] == (path,) and len(seen[1]) == 2 and not {f.split("/")[-1] for f, _ in before} & {f.split("/")[-1] for f in seen[1]}
    assert {(r["file"], r["column"]): r["mean"] for r in now.collect() if (r["file"], r["column"]) in before} == before
    _same(states.shape_measures(states.merged_states(now)).drop("null_count"), profiling.moments(table, NUMBERS).drop("null_count").select(
        "column", "n", "mean", "std", "min", "max", "skewness", "kurtosis"))
    seen.clear()
    states.file_states(spark, path, store, read=read)
    assert seen == [(path,)]
    # The roll-up of missing cells needs no further look at the files.
    sizes = states.file_sizes(now)
    assert sizes.count() == 3 and evidence.rollup(sizes).first()["file_count"] == 3
    want = evidence.table_sizes({"all": spark.read.parquet(path)}).first()
    assert sizes.agg(F.sum("missing")).first()[0] == want["missing"] and sizes.agg(F.sum("cells")).first()[0] == want["cells"]


def test_files_grow_in_number_not_in_size(spark, data, monkeypatch):
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    six = spark.read.parquet(descriptive._lineitem_files(spark, data))
    monkeypatch.setattr(descriptive, "_FILE_BYTES", descriptive.scale.plan_bytes(spark.read.parquet(f"{data}/lineitem.parquet")) // 20)
    more = spark.read.parquet(descriptive._lineitem_files(spark, data))
    assert len(six.inputFiles()) == 6 and len(more.inputFiles()) >= 20 and six.count() == more.count() == rows
    # No file, and so no task that writes or reads it, holds much more than its share, whatever the suppliers.
    most = more.groupBy("_metadata.file_path").count().agg(F.max("count")).first()[0]
    assert most < 3 * rows / len(more.inputFiles())
    columns = ["column", "rows", "present", "n"]
    whole = lambda: sorted(tuple(r[c] for c in columns) for r in descriptive.QUERIES["file_states_sizes"](spark, data).collect())
    found = whole()
    monkeypatch.undo()
    assert found == whole() and len(found) == 11
