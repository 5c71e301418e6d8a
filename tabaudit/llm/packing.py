"""Pack tokenised documents into sequences of bounded length.

Only the histogram of piece lengths, one number per possible length, decides
the plan: best fit, longest first, over counts of equal sequences instead of
single documents.  Every piece has a rank among the pieces of its length and
takes the slot that the plan holds for that rank.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tabaudit.llm.common import broadcast_if_small
from tabaudit.operators.scale import materialize

CAPACITY = 4096
END = 1

# A text is tokenised in parts of about so many bytes, cut at white space.
PART = 1 << 20
# A worker remembers the ids of so many stretches between white space of at most so many bytes.
KNOWN = 300_000
KNOWN_BYTES = 48
# So many bytes of ids are handed on at once.
HANDED = 1 << 23
BLANK = re.compile(rb"[\t-\r ]")
# Pre-tokens of the word model: contractions, words, single digits, other signs (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words of letters whose lower case is one letter and that no normal form changes; signs that are no part of words.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
SIGNS = b".,;:!?()\"-"
# A stop or comma after a letter and before white space is a pre-token of its own.
STOP, COMMA = re.compile(rb"\.(?<=[a-z]\.)(?=[\t-\r ])"), re.compile(rb",(?<=[a-z],)(?=[\t-\r ])")
# Special tokens begin so; combining marks (from U+0300 to U+036F) may join a capital letter otherwise than a small one.
SPECIAL = (b"<|", b"\xcc", b"\xcd")
# Byte-level models write bytes that are not printable in Latin-1 as the characters from 256 on.
LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class Stretches(dict):
    """Ids of stretches between white space as little-endian unsigned 32-bit numbers.

    No token crosses white space in the models that ``tokenize`` takes, so the
    ids of a text are those of its stretches.  The library encodes each; a
    plain word with signs around it skips normaliser and pre-tokeniser, which
    leave nothing to do but lower case, and meets the model at once.  Two
    generations are remembered: a full newer one becomes the older, from
    which stretches met again pass on.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task: Spark spreads the work
        self.tokenizer = Tokenizer.from_str(model)
        self.model = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}
        spec = json.loads(model)
        if self._ids("a b") != self._ids("a") + self._ids("b") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only models that drop white space between words are encoded by stretch")
        steps = [s["type"] for k in ("normalizer", "pre_tokenizer") for s in (spec[k] or {}).get("normalizers" if k == "normalizer" else "pretokenizers", [])]
        self.direct = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, part: bytes) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            word = part.strip(SIGNS) if self.direct else b""
            if not PLAIN.fullmatch(word):
                ids = np.array(self._ids(part.decode()), "<u4").tobytes()
            elif len(word) == len(part):
                lower = word.decode().lower().encode()
                if lower != part:
                    ids = self[lower]
                else:
                    ids = np.array([t.id for t in self.model.tokenize(lower.decode("latin-1").translate(LEVEL))], "<u4").tobytes()
            else:
                at = part.index(word)
                ids = b"".join(self[p] for p in (part[:at], word, part[at + len(word) :]) if p)
        if len(part) <= KNOWN_BYTES:
            self[part] = ids
        return ids

    def of(self, raw: bytes) -> bytes:
        if len(self) > KNOWN:
            self.old = dict(self)
            self.clear()
        if self.direct and not any(mark in raw for mark in SPECIAL):
            # Fewer different stretches: lower case, and a stop or comma that ends a word stands alone.
            raw = COMMA.sub(b" ,", STOP.sub(b" .", raw.lower()))
        return b"".join(map(self.__getitem__, raw.split()))


@lru_cache(maxsize=1)
def _stretches(model: str) -> Stretches:
    return Stretches(model)


def _parts(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > PART and (cut := BLANK.search(raw, at + PART)):
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


def tokenize(
    docs: DataFrame, model_path: str, capacity: int = CAPACITY, end: int = END, identity: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (doc_id, piece, start, length, ids).

    ``ids`` are the library's, without added tokens, then ``end``, as
    little-endian unsigned 32-bit numbers.  A document of more tokens is cut
    every ``capacity`` tokens; ``start`` counts its ids before the piece.
    A null or empty text is the piece of ``end`` alone.  Texts may be of any
    length; null ids and repeated rows stay; other columns are ignored.
    """
    with open(model_path, encoding="utf-8") as file:
        model = file.read()
    Stretches(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width, last = 4 * capacity, np.array([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _stretches(shared.value)
        for batch in batches:
            rows, numbers, ids, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                number = pa.array(numbers, pa.int64())
                return pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows, pa.int64())), number.cast(pa.int32()),
                    pa.array([n * capacity for n in numbers], pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                ], ["doc_id", "piece", "start", "length", "ids"])

            for row, value in enumerate(batch.column(1)):
                raw = (value.as_py() or "").encode("utf-8", "replace")
                whole = b"".join([*map(known.of, _parts(raw)), last])
                for number, at in enumerate(range(0, len(whole), width)):
                    rows.append(row)
                    numbers.append(number)
                    ids.append(whole[at : at + width])
                    size += len(ids[-1])
                if size > HANDED:
                    yield flush()
                    rows, numbers, ids, size = [], [], [], 0
            yield flush()

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[identity].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return docs.select(identity, text).mapInArrow(pieces, schema)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan: rows (length, first rank, per sequence, first sequence, offset), in order of length and rank.

    Sequences that hold the same lengths are one entry, (first sequence,
    number), listed under the room left in them.  From the longest length on,
    the entries with the least sufficient room take as many pieces as fit,
    then new sequences are begun, as best fit does piece by piece.  A length
    splits one entry and begins two at most, so the plan is bounded by the
    capacity, whatever the counts.
    """
    rooms: list[int] = []
    entries: dict[int, list[tuple[int, int]]] = {}
    plan, begun = [], 0

    def leave(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in entries:
                insort(rooms, room)
            entries.setdefault(room, []).append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            each, left = room // length, count - rank
            if at < len(rooms):
                first, number = entries[room].pop()
                if not entries[room]:
                    del entries[room], rooms[at]
            else:
                first, number = begun, -(-left // each)
                begun += number
            full = min(number, left // each)
            odd = left - full * each if full < number else 0
            plan.append((length, rank, each, first, capacity - room))
            rank += full * each + odd
            leave(room - each * length, first, full)
            if odd:
                leave(room - odd * length, first + full, 1)
            leave(room, first + full + (odd > 0), number - full - (odd > 0))
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


# Ranks are numbered below this within one length.
_RANKS = 1 << 48


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """All rows and columns of ``pieces`` with ``sequence_id`` and ``offset``.

    The rows of a sequence fill it from offset 0 without gaps, to ``capacity``
    at most.  Rows whose length is null, not positive or above the capacity
    take no slot: both columns are null.  Equal rows are rows of their own, an
    empty table gives no rows, and columns named like the two new ones give
    way.  The rows are written once; which rows share a sequence depends on
    their order.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    size = F.col(f"`{length}`").cast("long")
    packed = F.when(size.between(1, capacity), size).alias("_length")
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), packed)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = np.array(batch.column(1).fill_null(0), np.int64)
            order = np.argsort(lengths, kind="stable")
            counts = np.bincount(lengths, minlength=capacity + 1)
            before = np.empty(len(lengths), np.int64)
            before[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(lengths), part, np.int64)), pa.array(before + met[lengths])], ["_row", "_length", "_part", "_rank"]
            )
            met += counts

    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_rank", T.LongType())])
    placed = materialize(rows.mapInArrow(ranked, schema), "pieces")
    # Of each task, one count per length; a length's ranks go on from task to task.
    counts = materialize(placed.filter("_length is not null").groupBy("_length", "_part").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["_length"]: r["n"] for r in counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    earlier = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    shared = spark.sparkContext.broadcast(best_fit(histogram, capacity))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        starts = plan[:, 0] * _RANKS + plan[:, 1]
        for batch in batches:
            lengths = batch.column(1)
            known = np.array(lengths.fill_null(0), np.int64)
            rank = np.array(batch.column(2).fill_null(0), np.int64)
            out = [pa.nulls(batch.num_rows, pa.int64())] * 2
            if len(plan):
                slot = plan[np.maximum(np.searchsorted(starts, known * _RANKS + rank, "right") - 1, 0)]
                turn = rank - slot[:, 1]
                none = known == 0
                out = [pa.array(slot[:, 3] + turn // slot[:, 2], mask=none), pa.array(slot[:, 4] + turn % slot[:, 2] * known, mask=none)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["_row", "sequence_id", "offset"])

    joined = placed.join(broadcast_if_small(offsets), ["_length", "_part"], "left").select("_row", "_length", (F.col("_rank") + F.col("_before")).alias("_rank"))
    schema = T.StructType([rows.schema["_row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return joined.mapInArrow(slots, schema).select(*[F.col("_row")[c].alias(c) for c in columns], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, n_pieces, length, ids), from ``pack`` of ``tokenize``.

    A sequence has at most ``capacity`` tokens and thus as many pieces at most.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.filter("sequence_id is not null").groupBy("sequence_id").agg(
        F.count("*").alias("n_pieces"), F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(inside, lambda x: x["ids"]), "")).alias("ids")
    )
