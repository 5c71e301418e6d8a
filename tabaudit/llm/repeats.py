"""Substring dedup with prefix-partitioned sparse suffix trees.

Only suffixes at anchors enter the trees: the anchor of a window of words is
its least prefix of ``PREFIX`` words by hash, so equal windows have equal
anchors at equal places and every window has one.  Suffixes are split by
prefix; a prefix found once is dropped, prefixes share memory-sized groups,
and a prefix with more suffixes than a group may hold is lengthened to the
whole window, where counting replaces the tree.  In a group, suffixes are
sorted; the longest common prefixes of neighbours are the depths of the
tree's internal nodes, and a node deep enough for a window whose left part
also agrees is a repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import WordHashes, mixed, nullable, rolling, row_key, words_of
from tabaudit.operators.scale import materialize

WINDOW = 35
PREFIX = 10
# Suffixes in one tree group, and the most one prefix may bring to it.
GROUP_ROWS = 50_000
PREFIX_ROWS = 20_000
# The filter of repeated prefixes has 16 bits for each, at most 64 MB.
MOST_BITS = 29


def anchors(hashes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(prefix hash, place, first window, last window) of every anchor of one document."""
    keys = rolling(hashes, prefix)
    span = window - prefix + 1
    if len(keys) < span:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    least = np.lib.stride_tricks.sliding_window_view(keys, span).argmin(1) + np.arange(len(keys) - span + 1)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    return keys[least[first]], least[first], first, last


def _bits(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - width)
    return keys >> shift, mixed(keys) >> shift


def _prefix_counts(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """How often each anchor prefix occurs: (key, n)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for value in batch.column(0):
                held.append(anchors(hashes.of(words_of(value.as_py(), False)), window, prefix)[0])
                size += len(held[-1])
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return docs.select("text").mapInArrow(read, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _filter_table(repeated: DataFrame, total: int) -> tuple[int, np.ndarray]:
    """A bit table that holds every repeated prefix; its size is bounded, and a false hit only costs a row."""
    width = min(MOST_BITS, max(16, math.ceil(math.log2(16 * max(total, 1)))))
    chunks = 64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(0).to_numpy()
            for chunk in np.unique(bit >> (width - 6)):
                own = bit[bit >> (width - 6) == chunk] & ((1 << (width - 6)) - 1)
                tables.setdefault(int(chunk), np.zeros(1 << (width - 6), bool))[own] = True
        yield pa.RecordBatch.from_arrays([
            pa.array(list(tables), pa.int32()), pa.array([np.packbits(t).tobytes() for t in tables.values()], pa.binary()),
        ], ["chunk", "bits"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), width)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both)], ["bit"])

    bits = repeated.select("key").mapInArrow(places, "bit long").withColumn("part", F.shiftright("bit", width - 6))
    rows = bits.repartition(chunks, "part").select("bit").mapInArrow(read, "chunk int, bits binary").toArrow().to_pydict()
    out = np.zeros((chunks, (1 << (width - 6)) // 8), np.uint8)
    for chunk, packed in zip(rows["chunk"], rows["bits"]):
        out[chunk] = np.frombuffer(packed, np.uint8)
    return width, out.ravel()


def _suffixes(docs: DataFrame, width: int, table: np.ndarray, window: int, prefix: int) -> DataFrame:
    """Anchored suffixes whose prefix may repeat, with the words of all their windows."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), shared.value
        hit = lambda at: (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
        names = ["key", "row_key", "at", "first", "last", "words"]
        rows: list[list] = [[] for _ in names]
        batch_of = lambda: pa.RecordBatch.from_arrays([
            *[pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in rows[:5]], pa.array(rows[5], pa.binary()),
        ], names)
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = hashes.of(words_of(value.as_py(), False))
                keys, at, first, last = anchors(words, window, prefix)
                a, b = _bits(keys, width)
                keep = np.flatnonzero(hit(a) & hit(b))
                if len(keep):
                    codes = words.astype(np.uint32)
                    for held, part in zip(rows, (keys[keep].view(np.int64), np.full(len(keep), row, np.int64), at[keep], first[keep], last[keep])):
                        held.append(part)
                    rows[5] += [codes[f : t + window].tobytes() for f, t in zip(first[keep].tolist(), last[keep].tolist())]
                if len(rows[5]) > 20_000:
                    yield batch_of()
                    rows = [[] for _ in names]
        yield batch_of()

    return docs.select("row_key", "text").mapInArrow(read, "key long, row_key long, at long, first long, last long, words binary")


def tree_repeats(key: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, words: list[bytes], window: int = WINDOW, prefix: int = PREFIX):
    """(first, last) repeated window of every suffix of a group; last < first where there is none."""
    n, left = len(key), window - prefix
    grid = np.zeros((n, left + window), np.uint32)
    size = (last - first + window).astype(np.int64)
    start = left - (at - first)
    flat = np.frombuffer(b"".join(words), np.uint32)
    row = np.repeat(np.arange(n), size)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + start[row]] = flat
    right = np.ascontiguousarray(grid[:, left:])
    # Sorted suffixes: the prefix hash, then the words from the anchor on.
    named = np.concatenate([key.astype(">i8").view(np.uint8).reshape(n, 8), right.astype(">u4").view(np.uint8).reshape(n, -1)], 1)
    order = np.argsort(np.ascontiguousarray(named).view(f"V{named.shape[1]}").ravel(), kind="stable")
    same = right[order][1:] == right[order][:-1]
    depth = np.where(same.all(1), window, same.argmin(1))
    depth[key[order][1:] != key[order][:-1]] = 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    back = np.zeros(n, np.uint64)
    for l in range(left + 1):
        if l:
            back = mixed(back * np.uint64(0x9E3779B97F4A7C15) + grid[:, left - l].astype(np.uint64) + np.uint64(1))
        # Suffixes that have a window reaching l words to the left; their nodes at the depth that the window still needs.
        node = np.concatenate([[0], np.cumsum(depth < window - l)]).astype(np.uint64)
        own = order[(l >= (at - last)[order]) & (l <= (at - first)[order])]
        if not len(own):
            continue
        place = np.empty(n, np.uint64)
        place[order] = node
        _, back_to, count = np.unique(mixed(place[own] * np.uint64(0xD6E8FEB86659FD93) + back[own]), return_inverse=True, return_counts=True)
        hit = own[count[back_to] > 1]
        begin = at[hit] - l
        low[hit] = np.minimum(low[hit], begin)
        high[hit] = np.maximum(high[hit], begin)
    return low, high


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """Word spans (row_key, start, end) covered by windows that also start elsewhere; input (row_key, text)."""
    counts = materialize(_prefix_counts(docs, window, prefix).filter("n > 1"), "prefixes")
    total, suffixes = counts.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("n") <= prefix_rows, F.col("n"))), F.lit(0))).first()
    width, table = _filter_table(counts, total)
    groups = max(1, math.ceil(suffixes / GROUP_ROWS))
    found = _suffixes(docs, width, table, window, prefix).join(counts, "key")
    found = materialize(found.withColumn("group", F.when(F.col("n") <= prefix_rows, F.pmod(F.xxhash64("key"), F.lit(groups)))), "suffixes")

    def tree(data: pa.Table) -> pa.Table:
        column = {c: data.column(c).to_numpy() for c in ("key", "at", "first", "last", "row_key")}
        low, high = tree_repeats(column["key"], column["at"], column["first"], column["last"], data.column("words").to_pylist(), window, prefix)
        hit = high >= 0
        return pa.table({"row_key": column["row_key"][hit], "start": low[hit], "end": high[hit] + window})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, keys = [], [], []
            for row, first, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = rolling(mixed(np.frombuffer(words, np.uint32).astype(np.uint64)), window)
                keys.append(own)
                rows.append(np.full(len(own), row, np.int64))
                starts.append(first + np.arange(len(own)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(keys).view(np.int64))], ["row_key", "start", "key"])

    by_tree = found.filter("group IS NOT NULL").groupBy("group").applyInArrow(tree, "row_key long, start long, end long")
    crowded = found.filter("group IS NULL").select("row_key", "first", "words")
    long = materialize(crowded.mapInArrow(windows, "row_key long, start long, key long"), "windows")
    again = long.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    by_count = long.join(again, "key").select("row_key", "start", (F.col("start") + window).alias("end"))
    return by_tree.unionByName(by_count)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, identity: str = "doc_id", text: str = "text", prefix_rows: int = PREFIX_ROWS
) -> DataFrame:
    """``docs`` with repeated words removed, plus ``n_words`` and ``n_removed``; ``text`` holds the kept words joined by one blank.

    A word goes if a run of ``window`` words that covers it also starts
    anywhere else in the table, in the same text included; runs are judged on
    the input.  A null or empty text has no words and becomes empty.  Texts
    of fewer words than a window lose nothing.  Rows that repeat, id and text
    alike, repeat each other's windows.  An empty table gives no rows; null
    ids and other columns stay.
    """
    keyed = docs.withColumn("_row", row_key(identity, text))
    spans = repeated_spans(keyed.select(F.col("_row").alias("row_key"), F.col(text).alias("text")), window, prefix, prefix_rows)
    per_row = spans.distinct().groupBy("row_key").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    joined = keyed.join(per_row, keyed["_row"] == per_row["row_key"], "left").select(*kept, "_spans")
    at = kept.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for value, marks in zip(batch.column(at), batch.column(len(kept))):
                words = words_of(value.as_py(), False)
                if marks.is_valid:
                    mark = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mark, marks.values.field("start").to_numpy(), 1)
                    np.add.at(mark, marks.values.field("end").to_numpy(), -1)
                    keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
                    left = [words[i] for i in keep.tolist()]
                else:
                    left = words
                texts.append(b" ".join(left).decode("utf-8"))
                total.append(len(words))
                removed.append(len(words) - len(left))
            columns = batch.columns[: len(kept)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*kept, "n_words", "n_removed"])

    schema = nullable(docs.select(*kept)).add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(cut, schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35)),
dup AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS p FROM wins WHERE h IN (SELECT h FROM dup)),
kept AS (SELECT d.doc_id, count(*) AS n, string_agg(d.word, ' ' ORDER BY d.p) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
