"""Importance resampling, packing and periodic runs against brute force and odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabaudit.llm import importance, packing, queries, runs

MODEL = public_tokenizers.path("word_bpe_49k.json")


def _features(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def _drawn_by_force(rows, target, buckets, longest, percent, least, seed):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(code(f) for x in texts for f in _features(x, longest)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, text in rows:
        w, f = _features(text, longest)
        weight = sum(gain(code(x)) for x in f) // max(len(f), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, fit[: percent * len(fit) // 100]


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 50, "percent": 60, "least_words": 1, "seed": 1}, {"longest": 1, "percent": 100, "least_words": 0}, {"longest": 5, "percent": 0}])
def test_draw(spark, odd, monkeypatch, options):
    monkeypatch.setattr(importance, "JOINED", 100)
    monkeypatch.setattr(importance, "HELD", 7)
    rng = random.Random(4)
    words = ["Alpha", "beta", "ÉTÉ", "x1", "a\x00b", "--", "été", "z"]
    rows = [(i % 50, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 19, 20, 40])))) for i in range(120)]
    rows += [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()] + [(None, "alpha " * 25)] * 3 + [(7, "beta x1 " * 30)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("score", F.lit("clash")).withColumn("_at", F.lit(1))
    target = ["beta x1 z", None, "ÉTÉ été z z"]
    items = spark.createDataFrame([(x,) for x in target], "text string")
    plain = {"buckets": 10_000, "longest": 2, "percent": 25, "least_words": 20, "seed": 7, **options}
    want, chosen = _drawn_by_force(rows, target, plain["buckets"], plain["longest"], plain["percent"], plain["least_words"], plain["seed"])
    got = importance.draw(docs, items, **options).collect()
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(want, key=key)
    first = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(r["doc_id"], r["score"]) for r in first] == [(r[0], r[4]) for r in chosen] and [r["rank"] for r in first] == list(range(1, len(chosen) + 1))
    kept = importance.resample(docs, items, **options)
    assert kept.columns == docs.columns and kept.count() == len(chosen)
    assert sorted((r["doc_id"] for r in kept.collect()), key=key) == sorted((r[0] for r in chosen), key=key)


def test_draw_of_nothing(odd, nothing):
    assert importance.draw(nothing, odd).isEmpty() and importance.resample(nothing, nothing).isEmpty()
    rows = importance.draw(odd, nothing).collect()
    assert len(rows) == odd.count() and all(r["weight"] == 0 for r in rows if not r["n_features"])


def test_plans_match_best_fit_by_piece():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 5, 16, 50])
        sizes = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        plan, held, bins = packing.best_fit(sizes, capacity), collections.defaultdict(list), []
        for size in sizes:
            rows = plan[plan[:, 0] == size]
            for rank in range(sizes[size]):
                _, first, each, sequence, offset = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
                held[sequence + (rank - first) // each].append((offset + (rank - first) % each * size, size))
        for slots in held.values():
            slots.sort()
            assert [at for at, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))] and sum(slots[-1]) <= capacity
        for size in sorted(sizes, reverse=True):
            for _ in range(sizes[size]):
                room = min((r for r in bins if r >= size), default=None)
                if room is not None:
                    bins.remove(room)
                bins.append((capacity if room is None else room) - size)
        assert len(held) == len(bins)


def test_stretches_match_the_library(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 60)
    tokenizer = Tokenizer.from_file(MODEL)
    with open(MODEL, encoding="utf-8") as file:
        known = packing.Stretches(file.read())
    assert known.direct
    rng = random.Random(2)
    signs = ["a", "B", "'s", "'t", "ll", " ", "\n", "\t", "\u0085", "\x1c", "é", "é", "H̱", "İ", "́", "Σ", "ΑΣ", "ß", "1", "23", "!", "...", "<|endoftext|>", "<|ENDOFTEXT|>",
             "<|", "İ", "你好", "😀", "\x00", "\x0b", "'RE", "ﬁ", "‍", "﻿", "ǅ", "Ä", "é. ", "(Öl)", "÷", "×", "-", "Word, ", ".\n", "K", "\xa0"]
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(known.of(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark, data, odd, nothing, monkeypatch):
    monkeypatch.setattr(packing, "PART", 500)
    monkeypatch.setattr(packing, "HANDED", 5000)
    tokenizer = Tokenizer.from_file(MODEL)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for capacity in (4096, 64):
        pieces = packing.tokenize(docs, MODEL, capacity)
        rows = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")), capacity).collect()
        want = collections.Counter()
        for r in docs.select("doc_id").collect():
            ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
            for at in range(0, len(ids), capacity):
                want[r["doc_id"], at // capacity, at, zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes()), tuple(ids[at : at + capacity])] += 1
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
        held = collections.defaultdict(list)
        for r in rows:
            held[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
        for slots in held.values():
            slots.sort()
            assert [x[0] for x in slots] == [sum(x[1] for x in slots[:i]) for i in range(len(slots))] and sum(x[1] for x in slots) <= capacity
        assert len(held) <= -(-sum(r["length"] for r in rows) // capacity) + 2
        packed = packing.pack(pieces, capacity)
        whole = packing.sequences(packed).collect()
        assert len(whole) == len(held) and sorted(r["length"] for r in whole) == sorted(sum(x[1] for x in s) for s in held.values())
        assert all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.pack(packing.tokenize(nothing, MODEL)).isEmpty()
    other = spark.createDataFrame([(1, 0, "a"), (None, 1, "b"), (70, 2, "c"), (3, 3, None), (3, 3, None), (0, None, "d"), (-1, 4, "e")], "length long, _part int, offset string")
    got = packing.pack(other, 64).collect()
    assert len(got) == 7 and sorted(r["length"] for r in got if r["offset"] is not None) == [1, 3, 3] and {r["sequence_id"] for r in got} == {0, None}


def _runs_by_force(w, shortest):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(shortest, 2 * p):
                found[i, j - i + p] = min(p, found.get((i, j - i + p), p))
            i = max(i, j) + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_match_every_period():
    rng = random.Random(2)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 6)):
            kinds, n = rng.choice([1, 2, 2, 3, 6, 30]), rng.randint(0, 60)
            w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                q, at = rng.randint(1, n), rng.randrange(n)
                w[at:at] = w[:q] * rng.randint(1, 5)
            texts.append(w)
        shortest = rng.choice([2, 3, 5, 12, 12, 12])
        assert runs.find_runs(texts, shortest) == [_runs_by_force(w, shortest) for w in texts]


def test_long_periodic_texts():
    one = [b"a"] * 30_000
    line = [b"%d" % i for i in range(7)]
    apart = [x for i in range(3000) for x in [*line, b"z%d" % i]]
    assert runs.find_runs([one, apart, [b"a", b"b"] * 9_000, []]) == [[(0, 30_000, 1)], [], [(0, 18_000, 2)], []]


def test_collapse(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 30)
    rows = [(1, "x " + "a b c " * 5 + "y"), (2, "z " * 20), (3, None), (4, " \n"), (None, "k l " * 6 + "k"), (2, "z " * 20), (5, "p q r " * 3 + "p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(0))
    got = {(r["doc_id"], r["text"]): [tuple(x) for x in r["runs"]] for r in runs.collapse_runs(docs).collect()}
    assert got == {(1, "x a b c y"): [(1, 15, 3)], (2, "z"): [(0, 20, 1)], (3, ""): [], (4, ""): [], (None, "k l"): [(0, 13, 2)], (5, "p q r p q r p q r p q"): []}
    assert runs.collapse_runs(docs).count() == 7
    found = {(r["doc_id"], r["n_runs"]): r for r in runs.digests(runs.collapse_runs(docs)).collect()}
    assert found[(1, 1)]["exponent_milli"] == 5000 and found[(1, 1)]["runs_sha256"] == hashlib.sha256(b"1,15,3\n").hexdigest()
    assert found[(3, 0)]["start"] is None and found[(3, 0)]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert runs.collapse_runs(odd).count() == odd.count() and runs.collapse_runs(nothing).isEmpty()


def test_planted_periods(spark, odd):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = collections.Counter((r["doc_id"], r["text"]) for r in runs.with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = collections.Counter()
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))
        want[d, text] += 1
    assert got == want


def test_new_queries_are_registered():
    assert {"op11_importance_resampling", "op12_best_fit_packing", "op13_periodic_runs"} <= set(queries.QUERIES)
