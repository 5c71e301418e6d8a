"""Words hashed without an object for each, and tokens that no similar set can meet."""

import random
import tracemalloc

import pytest

from tabaudit.llm import common, jaccard, linedup

PARTS = ["a", "B", "é", "ß", "　", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "中", "z" * 7, "q" * 8, "w" * 9, "x" * 300, "\x00"]


def odd_texts(n):
    rng = random.Random(4)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(n)] + [None, "", "a\n\n b a\nB", "\n"]


def test_hashes_tell_words_apart():
    names = {}
    for text in odd_texts(500):
        data = (text or "").encode().lower()
        starts, hashes = common.hashed_words(data)
        words = data.split()
        assert [data[s : s + len(w)] for s, w in zip(starts.tolist(), words)] == words and len(starts) == len(hashes) == len(words)
        assert all(names.setdefault(h, w) == w for h, w in zip(hashes.tolist(), words))
    assert len(names) == len(set(names.values()))


@pytest.mark.parametrize("bits", [linedup.LINE_BITS, 0])
def test_sets_of_lines_hash_no_single_words(monkeypatch, bits):
    monkeypatch.setattr(linedup, "LINE_BITS", bits)
    # Hashing word by word took most of the CPU seconds of the first scan.
    monkeypatch.setattr(common, "LONG_WORD", 10_000)
    monkeypatch.setattr(common.xxhash, "xxh3_64_intdigest", None)
    texts = odd_texts(200)
    doc, number, size, digest, tokens = (x.tolist() for x in linedup.token_sets(texts))
    plain = [(i, j, frozenset(line.split())) for i, t in enumerate(texts) for j, line in enumerate((t or "").encode().lower().split(b"\n"))]
    plain = [x for x in plain if x[2]]
    assert list(zip(doc, number, size)) == [(i, j, len(s)) for i, j, s in plain] and len(tokens) == sum(size)
    of = dict(zip(digest, (s for _, _, s in plain)))
    assert [of[d] for d in digest] == [s for _, _, s in plain] and len(of) == len(set(of.values()))


@pytest.mark.parametrize("group", [1 << 18, 50, 1])
def test_shingle_sets(monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    names = {}
    for text, own in zip(texts := odd_texts(300), got := list(jaccard.shingle_sets(iter(odd_texts(300))))):
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        plain = frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()
        assert len(own) == len(plain) and own.tolist() == sorted(own.tolist())
        assert names.setdefault(tuple(own.tolist()), plain) == plain
    assert len(got) == len(texts) and len(names) == len(set(names.values()))


def test_shingle_sets_remember_no_words():
    # Each worker kept 200,000 words with their hashes, tens of MB, besides the JVM's heap.
    texts = (" ".join(f"word{i}x{j}" for j in range(100)) for i in range(3000))
    tracemalloc.start()
    assert sum(map(len, jaccard.shingle_sets(texts))) == 3000 * 96
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6


def test_tokens_without_a_possible_partner_leave(spark):
    rng = random.Random(5)
    rows = {(t, rng.randrange(10**6)): (n := rng.choice([4, 20, 30, 100, 130]), rng.randrange(n // 4 + 1)) for t in range(300) for _ in range(rng.choice([2, 2, 3, 4, 9]))}
    met = spark.createDataFrame([(t, node, (n << 32) + p, 2) for (t, node), (n, p) in rows.items()], "token long, node long, place long, c long")
    got = {(r["token"], r["node"]) for r in jaccard._partnered(met, 75).collect()}
    fit = lambda a, b: 100 * min(a[0], b[0]) >= 75 * max(a[0], b[0]) and min(a[0] - a[1], b[0] - b[1]) * 175 >= (a[0] + b[0]) * 75
    buckets = {}
    for (t, node), place in rows.items():
        buckets.setdefault(t, {})[node] = place
    for t, own in buckets.items():
        want = {x for x in own if any(fit(own[x], own[y]) for y in own if y != x)}
        kept = {x for x in own if (t, x) in got}
        # Small buckets are searched through; of larger ones no possible partner is lost.
        assert kept == want if len(own) <= jaccard.NEIGHBOURS + 1 else kept >= want
    assert 0 < len(got) < len(rows)
