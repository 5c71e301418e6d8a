"""Find stretches of words that repeat with a period, and collapse them.

Two places i < j of a text form a maximal pair of length l if the l words from
both agree, the words before differ and the words after differ.  Such a pair
with j - i <= l is a stretch from i to j + l with period j - i that no
neighbour extends: exactly a run, and no run is missed.  Maximal pairs come
from the tree of LCP intervals, built bottom-up over the sorted suffixes of
many texts at once.  Every interval keeps its places by the word left of them,
and joining two intervals pairs places of different left words only, those
within the interval's length of each other.

A run of length 12 or more needs agreeing stretches of six words, so only
texts that repeat six words have their suffixes sorted, and only intervals
whose places are near enough and have different left words are walked.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.llm.common import WORD, mixed, rolling

SHORTEST = 12
# Texts of together about so many words are handled at once; a longer one alone.
WORDS = 1 << 17

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Interval:
    """Places of an LCP interval, all of them and by left word, in order."""

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}

    def take(self, place: int, left: int) -> None:
        insort(self.places, place)
        insort(self.classes.setdefault(left, []), place)

    def near(self, place: int, left: int, depth: int, lefts: dict[int, int]) -> list[int]:
        """Places within ``depth`` words of ``place`` whose left word is another."""
        low, high = bisect_left(self.places, place - depth), bisect_right(self.places, place + depth)
        if high - low <= len(self.classes):
            return [p for p in self.places[low:high] if lefts[p] != left]
        return [
            p for other, own in self.classes.items() if other != left
            for p in own[bisect_left(own, place - depth) : bisect_right(own, place + depth)]
        ]


def _pairs(places: list[int], depths: list[int], lefts: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs (place, distance, length), at most as far apart as long, of suffixes in order.

    ``depths`` are the words that neighbours in order share; ``lefts[p]`` is
    the word left of place p.
    """
    stack: list[tuple[int, _Interval]] = []

    def join() -> Iterator[tuple[int, int, int]]:
        depth, upper = stack.pop()
        below, lower = stack.pop()
        small, large = sorted((upper, lower), key=lambda x: len(x.places))
        for left, own in small.classes.items():
            for p in own:
                for q in large.near(p, left, depth, lefts):
                    yield min(p, q), abs(p - q), depth
        for left, own in small.classes.items():
            for p in own:
                large.take(p, left)
        stack.append((below, large))

    for place, depth in zip(places, [0, *depths]):
        while len(stack) > 1 and stack[-1][0] > depth:
            yield from join()
        stack.append((depth, _Interval(place, lefts[place])))
    while len(stack) > 1:
        yield from join()


def _sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, words shared with the place before), by doubling the compared prefix.

    Shared words are exact.  Places are numbered in the order of their
    suffixes; ``words`` ends with a number of its own, so all suffixes differ.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 0
        step[1:] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = step
        width *= 2
        if step[-1] == n - 1:
            break
        levels.append(rank)
    # From the widest prefix down, neighbours go on by what they share.
    one, two = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (one < n) & (two < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[level][one[inside]] == levels[level][two[inside]]
        step = same * (1 << level)
        shared, one, two = shared + step, one + step, two + step
    return order, np.concatenate([[0], shared])


def _walked(order: np.ndarray, shared: np.ndarray, lefts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, shared words of neighbours) of the subtrees that may hold a pair."""
    deep = shared >= least
    # A subtree is a place that shares too little with the one before it and all after it that share enough.
    at = np.flatnonzero(deep | np.append(deep[1:], False))
    if not len(at):
        return
    places, of = order[at], np.cumsum(~deep)[at]
    by = np.lexsort((places, of))
    inner = of[1:] == of[:-1]
    starts = np.flatnonzero(np.append(True, ~inner))
    # Nearest two places, most shared words, and different left words of each.
    nearest = np.minimum.reduceat(np.append(np.where(inner, np.diff(places[by]), len(order)), len(order)), starts)
    deepest = np.maximum.reduceat(np.where(deep[at], shared[at], 0), starts)
    word = lefts[places]
    several = np.minimum.reduceat(word, starts) < np.maximum.reduceat(word, starts)
    held = (nearest <= deepest) & several
    for s, e in zip(starts[held], np.append(starts[1:], len(at))[held]):
        yield places[s:e], shared[at[s + 1 : e]]


def find_runs(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Of every list of words its runs (start, length, period), by start, then period."""
    least = max(1, -(-shortest // 2))
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    # A number of its own ends every text, so nothing agrees across texts.
    parts = [np.array([*map(numbers.__getitem__, words), -1 - i], np.int64) for i, words in enumerate(texts)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    every = np.concatenate(parts) if parts else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    grams = rolling(mixed(every.view(np.uint64)), least)
    order = np.argsort(grams, kind="stable")
    own = owner[order]
    again = (grams[order][1:] == grams[order][:-1]) & (own[1:] == own[:-1])
    chosen = np.unique(own[1:][again])
    if not len(chosen):
        return found
    words = np.concatenate([parts[i] for i in chosen])
    begins = np.cumsum([0, *[len(parts[i]) for i in chosen]])
    lefts = np.concatenate([[-1 - len(texts)], words[:-1]])
    runs: dict[tuple[int, int], int] = {}
    for places, shared in _walked(*_sorted_suffixes(words), lefts, least):
        left = dict(zip(places.tolist(), lefts[places].tolist()))
        for place, period, length in _pairs(places.tolist(), shared.tolist(), left):
            if length + period >= shortest:
                key = place, length + period
                runs[key] = min(period, runs.get(key, period))
    for (place, length), period in sorted(runs.items(), key=lambda x: (x[0][0], x[1])):
        at = int(np.searchsorted(begins, place, "right")) - 1
        found[chosen[at]].append((place - int(begins[at]), length, period))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left, joined by one blank, when every run keeps its first period only."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g])


def collapse_runs(docs: DataFrame, shortest: int = SHORTEST, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: (doc_id, runs, text), ``text`` without the repeated periods of its runs.

    A run is a stretch of words with smallest period q, of at least
    ``shortest`` words and two periods, that no neighbouring word extends.
    A word goes if a run holds it after the run's first q words.  Null, empty
    and blank texts have no runs and become empty texts.  Texts may be of any
    length and are held whole; null ids and repeated rows stay, an empty table
    gives no rows, other columns are ignored.
    """

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0

            def flush() -> pa.RecordBatch:
                runs = find_runs(held, shortest)
                cells = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                kept = [collapse(w, r).decode() for w, r in zip(held, runs)]
                return pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(held)), pa.array(cells, pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))),
                    pa.array(kept, pa.string()),
                ], ["doc_id", "runs", "text"])

            for at, value in enumerate(batch.column(1)):
                words = (value.as_py() or "").encode("utf-8", "replace").split()
                if held and size + len(words) > WORDS:
                    yield flush()
                    first, held, size = at, [], 0
                held.append(words)
                size += len(words)
            if held:
                yield flush()

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[identity].dataType), T.StructField("runs", T.StructType.fromDDL(f"r {RUNS}")["r"].dataType), T.StructField("text", T.StringType()),
    ])
    return docs.select(identity, text).mapInArrow(runs_of, schema)


def with_periods(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which the words of a tenth of the texts, chosen by their ids, repeat from some word on.

    Let h be the crc32 of the decimal id.  If 10 divides h, each word i >= a
    becomes word a + (i - a) mod p, with a = h/10 mod n and p = 1 + (n - a) div (3 + h/10 mod 8).
    A null id or a text without words leaves the row as it is.
    """
    h = F.crc32(F.col(identity).cast("string").cast("binary"))
    chosen = (h % 10 == 0) & F.col(text).rlike(WORD)
    # The choice comes first, so the words of other texts are never listed.
    planted = F.expr(f"""
      transform(array(regexp_extract_all(`{text}`, '{WORD}', 0)), w ->
        transform(array(struct(floor(crc32(cast(cast(`{identity}` as string) as binary)) / 10) as g, size(w) as n)), x ->
          transform(array(struct(cast(x.g % x.n as int) as a, x.n as n, x.g as g)), y ->
            transform(array(struct(y.a as a, y.n as n, cast(1 + (y.n - y.a) div (3 + y.g % 8) as int) as p)), z ->
              array_join(transform(sequence(0, z.n - 1), i -> w[if(i < z.a, i, z.a + (i - z.a) % z.p)]), ' '))[0])[0])[0])[0]""".replace("\\", "\\\\"))
    return docs.withColumn(text, F.when(chosen, planted).otherwise(F.col(text)))


def digests(found: DataFrame) -> DataFrame:
    """One row per text: number of runs, the longest run, and digests of all runs and of the collapsed text."""
    def sha(column: Column) -> Column:
        return F.sha2(column.cast("binary"), 256)

    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_r"), "runs", "text").select(
        "doc_id", "n_runs", (-F.col("_r.start")).alias("start"), F.col("_r.length").alias("length"), (-F.col("_r.period")).alias("period"),
        F.expr("1000 * _r.length div -_r.period").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("text")).alias("collapsed_sha256"),
    )


# Agreeing stretches of six words, chained word by word for each distance; no suffixes, no trees.
ORACLE = r"""
WITH RECURSIVE tables AS (
  SELECT list(list_reduce(range(8)::UBIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, n::UBIGINT) ORDER BY n) AS t
  FROM range(256) r(n)),
texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT),
      lambda c, b: xor(c >> 8, tables.t[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents, tables),
cuts AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts),
planted AS (
  SELECT row_no, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
    w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w FROM cuts),
words AS (SELECT row_no, unnest(range(n)) AS i, unnest(w) AS word FROM planted),
grams AS (
  SELECT row_no, i, string_agg(word, ' ') OVER six AS g, count(*) OVER six AS k FROM words
  WINDOW six AS (PARTITION BY row_no ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
met AS (
  SELECT x.row_no, x.i, y.i - x.i AS d FROM grams x JOIN grams y ON x.row_no = y.row_no AND x.g = y.g AND x.i < y.i WHERE x.k = 6 AND y.k = 6),
chained AS (SELECT *, i - row_number() OVER (PARTITION BY row_no, d ORDER BY i) AS chain FROM met),
pairs AS (SELECT row_no, d, min(i) AS start, max(i) - min(i) + 6 AS l FROM chained GROUP BY row_no, d, chain),
runs AS (SELECT row_no, start, l + d AS length, min(d) AS period FROM pairs WHERE l >= d AND l + d >= 12 GROUP BY ALL),
per_row AS (
  SELECT row_no, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, (length, -start, -period)) AS r,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY row_no),
gone AS (SELECT DISTINCT row_no, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row_no, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (row_no, i) GROUP BY row_no)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, r.s::BIGINT AS start, r.l::BIGINT AS length, r.p::BIGINT AS period,
  (1000 * r.l // r.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM planted LEFT JOIN per_row USING (row_no) LEFT JOIN kept USING (row_no)"""
