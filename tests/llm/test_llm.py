"""The operators against SQL, brute force and hand-made cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabaudit.llm import decontaminate, graph, jaccard, licenses, linedup, mixing, quality, queries, repeats, tokens, urls, vectors

MODEL = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    cur = duck.execute(queries.ORACLE[name])
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def test_mix_of_odd_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    copies = mixing.mixed_documents(odd)
    assert copies.columns == [*odd.columns, "epoch", "words_taken"] and copies.filter("words_taken < 1").isEmpty()
    assert mixing.mix(nothing).isEmpty() and mixing.mixed_documents(nothing).isEmpty()


def test_mixed_words_meet_the_budget_with_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "a", i) for i in range(40)] + [(2, "one two three", "b", 0)] * 9 + [(1, "a b c d e f g", "b", 1), (3, "x y", "b", 2)]
    rows += [(1, "a b c d e f g", None, i) for i in range(30)] + [(None, "n m", None, 0)] * 3 + [(4, None, None, 1), (4, "", "a", 1)]
    rows += [(i, f"d{i} e f g h", "d", 0) for i in range(100, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(5)
    for options in ({}, {"weights": (1, 3, 2, 5), "share": 0.4}, {"weights": (1,), "share": 0.13, "seed": 3}):
        targets = {r["source"]: (int(r["target"]), r["t"]) for r in mixing.mix(docs, **options).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()}
        out = mixing.mixed_documents(docs, **options).collect()
        for source, (target, taken) in targets.items():
            own = [r for r in out if r["source"] == source]
            assert sum(r["words_taken"] for r in own) == target == taken
            assert all(len(r["text"].split()) == r["words_taken"] > 0 for r in own)
        # Of every row the words that mix takes, and no row without them.
        want = sorted((r["doc_id"] or 0, r["source"] or "", r["taken"]) for r in mixing.mix(docs, **options).filter("taken > 0").collect())
        whole = {}
        for r in out:
            at = (r["doc_id"] or 0, r["source"] or "")
            whole.setdefault(at, []).append(r["words_taken"])
        sums = {}
        for d, s, taken in want:
            sums[d, s] = sums.get((d, s), 0) + taken
        assert {at: sum(x) for at, x in whole.items()} == sums


def test_urls(spark):
    rows = [(1, "http://A.example.net/en/x"), (2, "https://b.net/x?y"), (3, None), (4, "no scheme"), (5, "http://example.com/de"), (6, "http://x.example.com/de/1"),
            (7, "http://net"), (8, "http://notnet/"), (9, "http://o.org/fr/"), (9, "http://o.org/fr/"), (10, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, urls.rule_table(spark)).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"),
                   6: ("example.com/de/", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/fr/", "allow"), 10: (None, "allow")}
    partial = spark.createDataFrame([("block", "net", "/e")], "verdict string, host string, path string")
    assert urls.judge_urls(pages, partial).filter("verdict = 'block'").count() == 1
    assert urls.judge_urls(pages, partial.limit(0)).count() == len(rows)


def test_licenses(spark, odd, nothing):
    text = "Intro.\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\nCopyright 2020 X. Licensed under the Zebra licence."
    docs = spark.createDataFrame([(1, text), (2, "Released under the MIT License.\nAll rights reserved."), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert got[1]["licenses"] == "GPL-2.0-or-later" and got[1]["n_unknown"] == 1 and "copyright" in got[1]["sentence_ids"]
    assert got[2]["licenses"] == "MIT,Proprietary" and got[3]["sentence_ids"] == ""
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(nothing).isEmpty()


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD = """Copyright (c) 2020, Some Body

All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
NAMES = """3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_official_licenses(spark):
    unwrapped = lambda text: "\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    packed = lambda text: "\n".join(line for line in text.split("\n") if line.strip())
    marked = lambda text: "\r\n".join(f" * {line}" for line in text.split("\n"))
    mit, gpl = "copyright,mit-grant,mit-notice,as-is,mit-liability", "gpl-free,gpl-3-notice,gpl-no-warranty,gpl-no-implied,gpl-see,gpl-copy,unknown"
    bsd = "copyright,all-rights,bsd-grant,bsd-source,bsd-binary"
    three = BSD + NAMES.format("the copyright holder")
    named = [BSD + NAMES.format("Some Body Inc."), BSD + NAMES.format("the\n   Some Body")]
    shapes = [lambda text: text, unwrapped, packed, marked]
    texts = [(f(MIT), mit, "MIT") for f in shapes] + [(f(GPL), gpl, "GPL-3.0-or-later") for f in shapes]
    texts += [(f(x), bsd + ",bsd-name", "BSD-3-Clause,Proprietary") for f in shapes for x in (three, *named)] + [(f(BSD), bsd, "BSD-2-Clause,Proprietary") for f in shapes]
    texts += [
        ("Notes\nReleased under the\nMIT License\nmore words\nAll rights\nreserved", "mit-ref,all-rights", "MIT,Proprietary"),
        ("words on the\nZebra licence that\nwarrant nothing\n\nwarranty", "unknown,unknown", ""),
        ("dedicated to the public\n// domain by its author", "unknown", ""),
    ]
    docs = spark.createDataFrame([(i, x[0]) for i, x in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        _, ids, found = texts[r["doc_id"]]
        got = [x for x in r["sentence_ids"].split(",") if x != "unknown"], set(r["licenses"].split(","))
        assert got == ([x for x in ids.split(",") if x != "unknown"], set(found.split(","))), texts[r["doc_id"]][0]
        if r["doc_id"] >= len(texts) - 3:
            assert r["sentence_ids"] == ids and r["n_unknown"] == ids.count("unknown")


def test_token_counts(spark, data, odd, nothing):
    tokenizer = Tokenizer.from_file(MODEL)
    extra = spark.createDataFrame([(100, "a<|endoftext|>b  <|endoftext|>"), (101, "it's  \n\n 12ab ß　x"), (102, "x" * 50_000)], "doc_id long, text string")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(extra).unionByName(odd.select("doc_id", "text"))
    texts = {(r["doc_id"], len((r["text"] or "").encode())): r["text"] or "" for r in docs.collect()}
    for head in (100_000, 50):
        for r in tokens.count_tokens(docs, MODEL, head_rows=head).collect():
            n = len(tokenizer.encode(texts[(r["doc_id"], r["n_bytes"])], add_special_tokens=False).ids)
            assert r["n_tokens"] == n and r["over_limit"] == (n > 1024)
    assert tokens.count_tokens(nothing, MODEL).isEmpty()


def test_chains_match_enumeration():
    rng = np.random.default_rng(1)
    sizes, moves, first = np.array([3, 1, 4]), rng.normal(size=(2, 2)), rng.normal(size=2)
    scores = rng.normal(size=8)
    total, good, moved = quality.chains(scores, sizes, moves, first)
    at, expected_moves = 0, np.zeros((2, 2))
    for d, n in enumerate(sizes):
        z, marginal = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(first[y[0]] + sum(scores[at + i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            z += w
            marginal += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        assert total[d] == pytest.approx(np.log(z)) and good[at : at + n] == pytest.approx(marginal / z)
        expected_moves += pairs / z
        at += n
    assert moved == pytest.approx(expected_moves)


def test_quality(spark, data, odd, nothing):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, labels)
    held = judged.join(labels, "doc_id").filter("held_out")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count()
    scores = quality.judge(odd, labels).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert {r["score"] for r in quality.judge(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.judge(nothing, labels).isEmpty() and quality.good_documents(odd, labels).columns == odd.columns


def _lines_by_force(rows, threshold=80):
    seen, out = [], {}
    for d, text in sorted(rows):
        keep = []
        for line in text.split("\n"):
            own = frozenset(line.encode().lower().split())
            if own and any(100 * len(own & s) >= threshold * len(own | s) for s in seen):
                seen.append(own)
                continue
            if own:
                seen.append(own)
            keep.append(line)
        out[d] = "\n".join(keep)
    return out


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 2, "HELD": 5}, {"BUCKET": 50, "HELD": 7, "HOT_LEVEL": 5}, {"PAIRS": 0, "COMMON": 20, "BLOCK": 3}, {"PAIRS": 1, "HELD": 9}])
def test_line_dedup(spark, odd, nothing, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(linedup, name, value)
    rng = random.Random(3)
    words = [f"t{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    rows = []
    for d in range(60):
        lines = [list(rng.choice(base)) for _ in range(rng.randint(1, 5))]
        for line in lines:
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
        rows.append((d, "\n".join(" ".join(x) for x in lines) + ("\n\n" if d % 7 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(docs).collect()}
    assert got == _lines_by_force(rows)
    kept = {(r["doc_id"], r["n"]): r for r in linedup.dedup_lines(odd).collect()}
    assert kept[(3, 3)]["text"] is None and kept[(3, 3)]["n_lines"] == 0 and kept[(4, 4)]["n_lines"] == 1
    assert kept[(8, 9)]["n_removed"] == 1 and kept[(2, None)]["n_removed"] == 1 and kept[(1, 1)]["n_removed"] == 0
    assert linedup.dedup_lines(nothing).isEmpty()


def test_possible_partners():
    rng = np.random.default_rng(3)
    for threshold in (60, 80):
        n = rng.integers(1, 30, 400)
        token, pos = rng.integers(0, 20, 400), rng.integers(0, 30, 400) % n
        digest, bits = rng.integers(0, 100, 400), rng.integers(0, 1 << 20, 400).astype(np.uint64)
        order = np.lexsort((n, token))
        token, digest, n, bits, pos = (x[order] for x in (token, digest, n, bits, pos))

        def possible(i, j):
            alone = [bin(int(bits[a]) & ~int(bits[b])).count("1") for a, b in ((i, j), (j, i))]
            most = min(n[i] - pos[i], n[j] - pos[j], n[i] - alone[0], n[j] - alone[1])
            near = min(n[i], n[j]) * 100 >= max(n[i], n[j]) * threshold
            return token[i] == token[j] and digest[i] != digest[j] and near and most * (100 + threshold) >= (n[i] + n[j]) * threshold

        want = {(i, j) for i in range(400) for j in range(i + 1, 400) if possible(i, j)}
        one, two, crowded = linedup.possible_pairs(token, digest, n, [bits & np.uint64(0x3FF), bits & ~np.uint64(0x3FF)], pos, threshold)
        assert {(i, j) for i, j in want if not crowded[i]} == set(zip(one.tolist(), two.tolist()))
        for t in set(token.tolist()):
            own = sum(token[i] == t for i, _ in want)
            assert (own > linedup.PAIRS * (token == t).sum()) == crowded[token == t].any() == crowded[token == t].all()


def _components_by_force(rows):
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("radii", [(25, 0), (0,), (10, 5, 0)])
def test_jaccard_join(spark, radii):
    rng = random.Random(5)
    rows, word = [], lambda: f"v{rng.randrange(400)}"
    for g in range(6):
        source = [word() for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(12):
            copy = list(source)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "V1 v2"), (len(rows) + 3, "v1 V2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, radii=radii).collect()}
    assert got == _components_by_force(rows)


def test_jaccard_odd(odd, nothing):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(odd).collect()}
    assert got[(1, 11)] == got[(2, 12)] == got[(8, 11)] == 1 and got[(7, 2996)] == 7 and got[(3, 0)] == 3 and got[(4, 0)] == 4
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 7, None}
    assert jaccard.near_duplicates(nothing).isEmpty()


def test_one_row_of_each_group(spark):
    words = [f"c{i}" for i in range(60)]
    near = [" ".join(words[:i] + ["x"] + words[i + 1 :]) for i in (0, 30, 59)]
    rows = [(1, near[0], "b")] + [(1, near[0], "a")] * 50 + [(1, near[1], "a"), (None, near[2], "a"), (None, near[0], "a")]
    rows += [(None, "alone " * 3, s) for s in ("d", "c", "c")] + [(None, "Alone " * 3, "a"), (5, "single text", None)]
    rows += [(6, "", "a"), (6, "", "a"), (7, "", "a"), (None, None, "a"), (None, None, "a"), (8, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    kept = [tuple(r) for r in jaccard.one_of_each(docs).collect()]
    groups = {"c": [r for r in kept if r[1] in near], "alone": [r for r in kept if (r[1] or "").lower().startswith("alone")]}
    assert len(groups["c"]) == len(groups["alone"]) == 1 and groups["c"][0][0] == 1 and groups["c"][0][2] == "a"
    rest = [r for r in kept if r not in groups["c"] + groups["alone"]]
    assert sorted(rest, key=repr) == sorted([(5, "single text", None), (6, "", "a"), (7, "", "a"), (None, None, "a"), (8, " ", None)], key=repr)
    again = jaccard.one_of_each(docs.unionByName(docs).repartition(3)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(kept, key=repr)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    found = [(i, (centres[i % 40] + rng.normal(size=16) * 0.2 * (i % 4)).tolist()) for i in range(300)]
    found += [(300 + i, found[0][1]) for i in range(30)]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None]), (404, []), (405, [1.0, 2.0])]
    table = spark.createDataFrame(found + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    x = np.array([v for _, v in found])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    got = {r["vec_id"]: r for r in vectors.near_vectors(table).collect()}
    links = np.array([got[i]["n_links"] for i, _ in found])
    assert (links <= close.sum(1) - 1).all() and links.sum() >= 0.9 * (close.sum() - len(x))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
    assert got[329]["component_id"] == got[0]["component_id"] and not got[329]["kept"]
    assert vectors.near_vectors(table.limit(0)).isEmpty()


def test_crowded_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(4)
    near = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist()) for i in range(60)]
    got = vectors.near_vectors(spark.createDataFrame(near, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(59, 0)}


@pytest.mark.parametrize("prefix_rows", [20_000, 1])
def test_repeats(spark, prefix_rows):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for d in range(40):
        words = [f"u{rng.randrange(60)}" for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 10) :]
        rows.append((d, " ".join(words)))
    rows += [(40, "z " * 40), (41, rows[3][1]), (42, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = {}
    for d, text in rows:
        w = (text or "").split()
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = {(d, i + j) for places in seen.values() if len(places) > 1 for d, i in places for j in range(35)}
    want = {d: " ".join(x for i, x in enumerate((text or "").split()) if (d, i) not in gone) for d, text in rows}
    got = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs, prefix_rows=prefix_rows).collect()}
    assert got == want


def test_repeats_odd(odd, nothing):
    got = {(r["doc_id"], r["n"]): r for r in repeats.remove_repeats(odd).collect()}
    assert got[(3, 3)]["text"] == "" and got[(7, 7)]["n_removed"] == 3000 and got[(1, 1)]["n_removed"] == 0
    assert repeats.remove_repeats(nothing).isEmpty()


def test_decontamination(spark, odd, nothing):
    items = spark.createDataFrame([(1, LINE := "Fox jumps over"), (2, " ".join(f"w{i}" for i in range(100, 115))), (3, None), (4, "!!"), (5, "two")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination(odd, items).collect()}
    assert got[(1, 15)]["n_hit"] == 3 and got[(8, 15)]["n_hit"] == 3 and got[(7, 3000)]["n_hit"] == 15 and got[(6, 2)]["n_hit"] == 1
    assert got[(3, 0)]["n_items"] == 0 and not got[(3, 0)]["contaminated"]
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").isEmpty()
    assert decontaminate.contamination(nothing, items).isEmpty()
    kept = decontaminate.clean_documents(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, None}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 101), (None, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}
    assert graph.components(edges.limit(0)).isEmpty()


def test_pipeline(spark, data):
    docs, columns = spark.read.parquet(f"{data}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            out = corpus_pipeline.materialize(out, "stage")
            assert 0 < out.count() <= docs.count()
            docs = out
    assert {"epoch", "words_taken"} <= set(out.columns) and out.count() > 0


def _mixed_by_force(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    words = lambda r: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    targets, left = {}, share * sum(sizes.values())
    for s in sorted(sizes, key=lambda s: (most * sizes[s] / weight[s], s)):
        rest = sum(weight[x] for x in sizes if x not in targets)
        targets[s] = min(most * sizes[s], weight[s] * (left / rest))
        left -= targets[s]
    out = []
    for s, size in sizes.items():
        budget = int(targets[s] + 1e-6)
        for epoch in range(1, budget // max(size, 1) + 2):
            room = budget - (epoch - 1) * size
            own = [r for r in rows if r["source"] == s]
            for r in sorted(own, key=lambda r: (hashlib.md5(f"0#{r['doc_id']}".encode()).hexdigest(), r["doc_id"], len(words(r)))):
                taken = min(room, len(words(r)))
                room -= taken
                if taken > 0:
                    text = r["text"] if taken == len(words(r)) else " ".join(words(r)[:taken])
                    out.append((r["doc_id"], text, s, epoch, taken))
    return out


def test_pipeline_matches_plain_stages(spark, data, tmp_path):
    docs, labels, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = quality.fit(docs, labels)
    rows = [r.asDict() for r in docs.orderBy("doc_id").limit(60).collect()]
    scores = quality.score_texts(model, [r["text"] for r in rows])
    item = next(r["text"] for r in items.orderBy("item_id").collect() if len(r["text"].split()) >= 10)
    good = [r for r, s in zip(rows, scores) if s >= 0.5 and "\n" in r["text"].strip() and len(r["text"].split()) > 60]
    plant = lambda d, text, like: rows.append({**like, "doc_id": d, "text": text, "n_chars": len(text)})
    plant(1001, " ".join(good[0]["text"].split()), good[0])  # a near copy whose lines are not
    plant(1002, good[1]["text"], good[1])  # all lines repeat earlier ones
    plant(1003, " ".join((good[2]["text"] + "\n" + item).split()[20:]), good[2])  # a benchmark item
    rows += [dict(good[3])] * 3  # repeated rows
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")

    key = lambda r: (r["doc_id"], r["text"], r["source"], r["n_chars"])
    plain = {}
    # The classifier learns from the documents of the same table.
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = quality.score_texts(quality.fit(table, labels), [r["text"] for r in rows])
    plain["quality classifier"] = now = [r for r, s in zip(rows, scores) if s >= 0.5]
    texts = _lines_by_force({(r["doc_id"], r["text"]) for r in now})
    now = [{**r, "text": texts[r["doc_id"]], "n_chars": len(texts[r["doc_id"]])} for r in now if texts[r["doc_id"]] == r["text"] or texts[r["doc_id"]].split()]
    plain["line dedup"] = now
    roots = _components_by_force({(r["doc_id"], r["text"]) for r in now})
    plain["n-gram Jaccard join"] = now = list({r["doc_id"]: r for r in now if roots[r["doc_id"]][1] == r["doc_id"]}.values())
    split = lambda text: re.findall(decontaminate.ITEM_WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    windows = set()
    for r in items.collect():
        w = split(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    plain["benchmark decontamination"] = now = [r for r in now if not hit(split(r["text"]))]
    mixed = sorted(_mixed_by_force(now))
    # Every stage has something to do.
    sizes = [len(rows), *map(len, plain.values())]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > sizes[4] > 0, sizes

    found, out = table, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.materialize(stage(spark, found, str(tmp_path)), "stage")
        assert sorted(map(key, found.collect())) == sorted(map(key, plain[name])), name
    ends = lambda df: sorted((r["doc_id"], r["text"], r["source"], r["epoch"], r["words_taken"]) for r in df.collect())
    assert ends(corpus_pipeline.STAGES[-1][1](spark, found, str(tmp_path))) == mixed
    assert ends(corpus_pipeline.run(spark, str(tmp_path))) == mixed


def test_lines_with_many_matches_are_compared_few_times(spark, monkeypatch):
    # Windows of a ring of words, ten variants of each: every line has about 130 matches, and none matches all others.
    rng = random.Random(8)
    lines = [" ".join([f"w{(i + k) % 120}" for k in range(60)] + [f"v{i}x{v}"]) for i in range(120) for v in range(10)]
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)], "doc_id long, text string")
    asked, late = [], linedup._late
    monkeypatch.setattr(linedup, "_late", lambda pairs, near, threshold: asked.append(pairs.distinct().count()) or late(pairs, near, threshold))
    got = {r["doc_id"]: r["n_removed"] for r in linedup.dedup_lines(docs).collect()}
    sets = [set(x.split()) for x in lines]
    gone = [any(100 * len(s & t) >= 80 * len(s | t) for t in sets[:i]) for i, s in enumerate(sets)]
    assert got == {i: sum(gone[i : i + 4]) for i in range(0, len(lines), 4)}
    assert sum(asked) < 30_000


def test_word_count_holds_no_list_of_words(spark):
    texts = ["", None, "a", "  a\tb\nc\x0bd\x0ce\rf ", "x\u0085y z\u00a0q", "w ww w", "\x00 \x1f \x1c", "\U0001f600 \U0001f600\u3000é\r\n\r\n", "\n\n \n", "-" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(F.col("text")).alias("n"))
    assert {r["text"]: r["n"] for r in df.collect()} == {t: len((t or "").encode().split()) for t in texts}
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
