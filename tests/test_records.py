"""Records with line breaks in quotes, read in splits, against a machine over single characters."""

import random

import pytest

from tabaudit.queries import linking
from tabaudit.sources import csv, records


@pytest.fixture
def split_size(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    known = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[1], 0)
    yield lambda n: spark.conf.set(names[0], n)
    for n, v in known.items():
        spark.conf.set(n, v)


def _by_character(text, sep=","):
    out, state, record = [], "begin", ""
    for c in text:
        if state == "begin":
            state = "quoted" if c == '"' else "begin" if c == sep else "plain"
        elif state == "plain":
            state = "begin" if c == sep else "plain"
        elif state == "quoted":
            state = "closing" if c == '"' else "quoted"
        else:
            state = "quoted" if c == '"' else "begin" if c == sep else "plain"
        if c == "\n" and state != "quoted":
            out, record, state = [*out, record], "", "begin"
        else:
            record += c
    out = [r for r in [*out, record] if r.strip("\r\n")]
    return sorted((i == 0, r) for i, r in enumerate(out))


CELLS = ["a", '"x"', '"l1\nl2"', '"a""b"', '"\n\n"', '5" x', '"q""\n""r"', '"z"tail', "", "é", '"a,\nb"', '" "', 'x""y', '"c\r\nd"', '"e\rf"']


@pytest.mark.parametrize("seed", range(6))
def test_records_of_any_split(spark, tmp_path, split_size, seed):
    rng = random.Random(seed)
    rows = [["h1", '"h\n2"' if seed % 2 else "h2"]] + [[rng.choice(CELLS) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(0, 90))]
    text = rng.choice(["\n", "\r\n"]).join(",".join(r) for r in rows) + ("\n" if seed % 3 else "")
    text = ("\n" if seed == 4 else "") + text + ('"never closed\n1,2\n\n3' if seed == 5 else "")
    encoding = "ISO-8859-1" if seed % 2 else "UTF-8"
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode(encoding))
    for size, most in ((17, 100_000), (64, 0), (1 << 30, 100_000)):
        split_size(size)
        got = sorted((r["first"], r["record"]) for r in records.records(spark, str(path), ",", encoding, most).collect())
        assert got == _by_character(text), (size, most)


def test_load_in_splits_equals_one_task(spark, tmp_path, split_size):
    rng = random.Random(1)
    for name, head in (("a", "k,v,w"), ("b", "k,v,w"), ("c", "v,k")):
        cells = lambda: [str(rng.randint(0, 99)), rng.choice(['"x\ny"', '"a""b\n"', "t", "NA", '"p,\n\nq"']), rng.choice(["", "1.5", '"2"'])][: 2 + (name != "c")]
        lines = [",".join(cells()[::-1] if name == "c" else cells()) for _ in range(60)] + ["1", '2,"z\n",3,4,5']
        (tmp_path / f"{name}.csv").write_text("\n".join([head, *lines]) + "\n")
    split_size(50)
    got = csv.load(spark, str(tmp_path))
    want = csv.load(spark, str(tmp_path), multiline=True)
    assert got.schema == want.schema and got.count() > 150
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_record_over_many_splits(spark, tmp_path, split_size):
    value = "\n".join(["word"] * 500)
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{value}"\n2,x\n')
    split_size(40)
    assert {tuple(r) for r in csv.load(spark, str(tmp_path / "a.csv")).collect()} == {(1, value), (2, "x")}
    # A separator that means something in patterns, and a header with a line break.
    (tmp_path / "b.csv").write_text('"a\nz"|b\n"1|\n"|2\n3|"4"\n')
    assert {tuple(r) for r in csv.load(spark, str(tmp_path / "b.csv"), sep="|").collect()} == {("1|\n", 2), ("3", 4)}
    assert csv.load(spark, str(tmp_path / "b.csv"), sep="|").columns == ["a\nz", "b"]


def test_only_quoted_line_breaks_take_records(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('a,b\n"1",2\n')
    monkeypatch.setattr(csv, "records", None)
    assert csv.load(spark, str(tmp_path / "a.csv")).count() == 1


def test_a_task_reads_many_small_splits(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab c\n', 2000) AS text", "'en' AS lang", "'web' AS source")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}

    def load(s, path, **options):
        lines = s.read.text(path)
        seen.update(tasks=lines.rdd.getNumPartitions(), splits=lines.select("_metadata.file_block_start").distinct().count())
        return lines.limit(1)

    monkeypatch.setattr(linking.csv, "load", load)
    linking.QUERIES["csv_quoted_line_breaks"](spark, str(tmp_path))
    # Tasks are as many as the cores ask for, not as many as splits; the session's own settings are back.
    assert seen["splits"] > 400 and seen["tasks"] <= 4 * spark.sparkContext.defaultParallelism + 4
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
