import pytest
from pyspark.sql import functions as F

from tabaudit.plans.profile import metadata, profile
from tabaudit.sources import csv, files, headerless, sinks


def _write(tmp_path, name, text, encoding="latin-1"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_separators(spark, tmp_path, sep):
    rows = ["a b c", "1 2.5 x", "2 3.5 y", "3 4.5 z"]
    path = _write(tmp_path, "f.csv", "\n".join(r.replace(" ", sep) for r in rows) + "\n")
    df = csv.load(spark, path)
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert df.count() == 3


def test_sniff_rules():
    assert csv.sniff_separator("a;b,c") == ","
    assert csv.sniff_separator("a;b") == ";"
    assert csv.sniff_separator("a\tb,c") == "\t"
    assert csv.sniff_separator("a") == ","
    assert csv.header_names("a,,a,\"x,y\"", ",") == ["a", "Unnamed: 1", "a.1", "x,y"]


def test_dirty_file(spark, tmp_path):
    text = (
        "name,when,n,flag,x.y,\n"
        "é,2020-01-02,1,True,NA,\n"
        "b,2020-01-03,null,False,1e3,\n"
        "too,2020-01-04,3,True,2,,many,fields\n"
        "short,2020-01-05\n"
        "\"q,uoted\",2020-01-06,4,False,inf,\n"
        ",2020-01-07,5,True,12f,\n"
    )
    df = csv.load(spark, _write(tmp_path, "d.csv", text))
    assert df.columns == ["name", "when", "n", "flag", "x.y", "Unnamed: 5"]
    kinds = dict(df.dtypes)
    assert (kinds["when"], kinds["n"], kinds["flag"], kinds["Unnamed: 5"]) == ("string", "bigint", "boolean", "double")
    assert kinds["x.y"] == "string", "12f is not a number"
    rows = {r["when"]: r for r in df.collect()}
    assert set(rows) == {f"2020-01-0{i}" for i in (2, 3, 5, 6, 7)}, "the over-long line is gone"
    assert rows["2020-01-02"]["name"] == "é" and rows["2020-01-02"]["x.y"] is None
    assert rows["2020-01-05"]["n"] is None and rows["2020-01-06"]["name"] == "q,uoted"
    assert rows["2020-01-07"]["name"] is None


def test_numbers_and_infinity(spark, tmp_path):
    df = csv.load(spark, _write(tmp_path, "n.csv", "a,b,c\n 1,inf,99999999999999999999\n+2,-2.5e-3,1\n"))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "bigint")] or dict(df.dtypes)["c"] == "double"
    assert [r["a"] for r in df.orderBy("a").collect()] == [1, 2]
    assert max(r["b"] for r in df.collect()) == float("inf")
    assert dict(df.dtypes)["c"] == "double", "larger than BIGINT"


def test_line_break_inside_quotes(spark, tmp_path):
    path = _write(tmp_path, "q.csv", 'a,b\n"one\ntwo",1\nx,2\n')
    assert csv.has_open_quotes(spark, path)
    assert sorted(r["a"] for r in csv.load(spark, path).collect()) == ["one\ntwo", "x"]


def test_several_files_and_heads(spark, tmp_path):
    for i in range(3):
        _write(tmp_path, f"p{i}.csv", "a,b\n" + "".join(f"{i},{j}\n" for j in range(10)))
    assert csv.load(spark, str(tmp_path)).count() == 30
    assert csv.load(spark, str(tmp_path), heads=7).count() == 7


def test_strict_load_refuses_long_lines(spark, tmp_path):
    good = _write(tmp_path, "g.csv", "a,b\n1,x\n2,y\n", "utf-8")
    assert csv.load_strict(spark, good).count() == 2
    bad = _write(tmp_path, "b.csv", "a,b\n1,x\n2,y,z\n", "utf-8")
    with pytest.raises(Exception):
        csv.load_strict(spark, bad).collect()


def test_headerless(spark, tmp_path):
    path = _write(tmp_path, "u.data", "5.1, 3.5\tA\n4.9 ?,B\n\n6.0,2.0 C\n")
    df = headerless.load(spark, path)
    assert df.dtypes == [("0", "double"), ("1", "double"), ("2", "string")]
    assert sorted(r["2"] for r in df.collect()) == ["A", "C"]
    headerless.convert(spark, path, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_discovery_and_index(spark, tmp_path):
    for name in ("a.csv", "FUSED_x.csv", "deep/b.CSV", "deep/Hist_age.png", "deep/other.png", "deep/metadata.json", "notes.md"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x" * 2000)
    listed = files.inventory(spark, str(tmp_path))
    assert listed.count() == 7
    assert files.inventory(spark, str(tmp_path), recursive=False).count() == 3
    assert {r["filename"] for r in files.audit_inputs(listed).collect()} == {"a.csv", "b.CSV"}
    chart = files.chart_index(listed, str(tmp_path)).collect()
    assert [(c["chart_name"], c["type"], c["size_kb"], c["sheet_tab"], c["relative_path"]) for c in chart] == [
        ("Hist_age.png", ".PNG", 2.0, "Hist_age", "deep/Hist_age.png")]
    index = {r["relative_path"]: r["source_root"] for r in files.artifact_index(listed, str(tmp_path)).collect()}
    assert index["deep/b.CSV"] == "deep" and index["a.csv"] == ""
    assert files.metadata_files(listed).count() == 1


def test_formats(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(3).write.json(str(tmp_path / "t.json"))
    assert files.load_table(spark, str(tmp_path / "t.parquet")).count() == 3
    assert files.load_table(spark, str(tmp_path / "t.json")).count() == 3
    with pytest.raises(ValueError):
        files.load_table(spark, "x.pkl")


def test_log_and_manifest(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(sinks.log_rows(spark, [("a.csv", "SUCCESS", "AUC 0.9")]), path)
    sinks.append_log(sinks.log_rows(spark, [("b" * 40, "FAILED", "empty")]), path)
    log = spark.read.parquet(path)
    row = sinks.manifest(log).first()
    assert (row["inputs"], row["succeeded"], row["failed"], row["status"]) == (2, 1, 1, "completed_with_errors")
    lines = sorted(r["line"].split("] ")[1] for r in sinks.log_lines(log).collect())
    assert lines == ["a.csv".ljust(30) + " | SUCCESS    | AUC 0.9", "b" * 30 + " | FAILED     | empty"]


def test_a_repeated_run_replaces_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *names: sinks.log_rows(spark, [(n, "SUCCESS", "x") for n in names])
    sinks.commit_log(rows("a", "b", "c"), path, "2024-01-01 09:00/é=1")
    sinks.commit_log(rows("d"), path, "second")
    for _ in range(2):
        sinks.commit_log(rows("a", "e"), path, "2024-01-01 09:00/é=1")
    read = lambda run=None: sorted((r["run"], r["file"]) for r in sinks.read_log(spark, path, run).collect())
    assert read() == [("2024-01-01 09:00/é=1", "a"), ("2024-01-01 09:00/é=1", "e"), ("second", "d")] and read("second") == [("second", "d")]
    sinks.commit_log(rows("z").limit(0), path, "second")
    assert len(read()) == 3 and sinks.manifest(sinks.read_log(spark, path)).first()["inputs"] == 3


def test_profile_metadata_and_tables(spark, data, tmp_path):
    df = spark.read.parquet(f"{data}/customer.parquet")
    tables = profile(df)
    sinks.write_metadata(metadata(tables, "customer"), str(tmp_path / "meta"))
    back = spark.read.json(str(tmp_path / "meta")).first()
    assert back["overview"]["total_rows"] == df.count() and len(back["statistics"]) == 3
    sinks.write_tables(tables, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all" / "density")).count() == 3000
    assert "Mean:" in tables["summary"].first()["text"]
    assert sinks.as_json(df.select(F.lit(1).alias("a"))).first()["json"] == '{"a":1}'


def test_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a,c\n20,10,x\n")
    rows = {tuple(r) for r in csv.load(spark, str(tmp_path)).select("a", "b", "c").collect()}
    assert rows == {(1, 2, None), (10, 20, "x")}


def test_surplus_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4,,5\n\"6,6\",7\n")
    assert {tuple(r) for r in csv.load(spark, str(tmp_path / "a.csv")).collect()} == {("1", 2), ("6,6", 7)}


def test_headerless_keeps_long_lines(spark, tmp_path):
    (tmp_path / "x.data").write_text("1,2\n3,4,5\n")
    got = {tuple(r) for r in headerless.read_fields(spark, str(tmp_path / "x.data")).collect()}
    assert got == {("1", "2", None), ("3", "4", "5")}
