"""Token counts of whole texts from counts per distinct pre-token.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum
over its pre-tokens.  Every distinct pre-token of the corpus is encoded once.
The most frequent ones form a bounded table that goes to all workers; the
others are joined to per-document frequencies by shuffle.  Ids of documents
are never built.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabaudit.llm.common import row_key
from tabaudit.operators.scale import materialize

# At most so many frequent pre-tokens of at most so many bytes are broadcast.
HEAD_ROWS = 100_000
HEAD_BYTES = 64
# A task hands its counts on when it holds this many distinct pre-tokens.
HELD = 50_000
# Pre-tokens of byte-level BPE: contractions, words, numbers, other signs, white space (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def specials_of(model: str) -> list[str]:
    return [t["content"] for t in json.loads(model)["added_tokens"] if t["special"]]


def splitter(specials: list[str]):
    """A function text -> (pre-tokens, number of special strings)."""
    find = regex.compile(PATTERN).findall
    if not specials:
        return lambda text: (find(text), 0)
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))).split

    def split(text: str) -> tuple[list[str], int]:
        parts = cut(text)
        if len(parts) == 1:
            return find(text), 0
        return [p for part in parts for p in find(part)], len(parts) - 1

    return split


def _checked(model: str) -> None:
    spec = json.loads(model)
    level = spec["pre_tokenizer"] or {}
    if level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex") or spec["normalizer"]:
        raise ValueError("only byte-level models without normaliser and prefix blank are counted by pre-token")


def vocabulary(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Every distinct pre-token of the corpus: (piece, n, tokens)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = splitter(specials_of(shared.value)), Counter()
        flush = lambda: pa.RecordBatch.from_pydict({"piece": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        for batch in batches:
            for value in batch.column(0):
                held.update(split(value.as_py() or "")[0])
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        yield flush()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task: Spark spreads the work
        tokenizer = Tokenizer.from_str(shared.value)
        for batch in batches:
            found = tokenizer.encode_batch(batch.column("piece").to_pylist(), add_special_tokens=False)
            yield batch.append_column("tokens", pa.array([len(e.ids) for e in found], pa.int64()))

    pieces = docs.select(text).mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return pieces.mapInArrow(encoded, "piece string, n long, tokens long")


def frequent(known: DataFrame, rows: int = HEAD_ROWS, size: int = HEAD_BYTES) -> dict[str, int]:
    """The most frequent short pre-tokens, whole powers of two of frequency at a time, at most ``rows``."""
    short = known.filter(F.octet_length("piece") <= size).withColumn("level", F.floor(F.log2("n")).cast("int"))
    # One row per power of two.
    levels = {r["level"]: r["count"] for r in short.groupBy("level").count().collect()}
    total, lowest = 0, None
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > rows:
            break
        lowest = level
    if lowest is None:
        return {}
    chosen = short.filter(F.col("level") >= lowest).select("piece", "tokens").toArrow()
    return dict(zip(chosen.column("piece").to_pylist(), chosen.column("tokens").to_pylist()))


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 1024, identity: str = "doc_id", text: str = "text", head_rows: int = HEAD_ROWS
) -> DataFrame:
    """Per row: (doc_id, n_bytes, n_tokens, over_limit).

    Counts equal the library's for the whole text, without added tokens;
    strings of special tokens inside a text count as the special token, the
    library's default.  A null or empty text has no bytes and no tokens.
    Texts may be of any length, null ids and repeated rows stay, an empty
    table gives no rows, other columns are ignored.  ``over_limit`` is
    ``n_tokens > limit``.
    """
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as file:
        model = file.read()
    _checked(model)
    known = materialize(vocabulary(docs, model, text), "vocabulary")
    shared = spark.sparkContext.broadcast((specials_of(model), frequent(known, head_rows)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, head = shared.value
        split = splitter(specials)
        for batch in batches:
            keys, pieces, times, sums = [], [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, total = split(value.as_py() or "")
                rest = []
                for piece, n in Counter(found).items():
                    tokens = head.get(piece)
                    if tokens is None:
                        rest.append((piece, n))
                    else:
                        total += tokens * n
                # The sum of the frequent ones travels with one of the others, or with a piece counted no times.
                for piece, n in rest or [(max(found, key=len, default=""), 0)]:
                    keys.append(key)
                    pieces.append(piece)
                    times.append(n)
                    sums.append(total)
                    total = 0
                if len(keys) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pieces, pa.string()), pa.array(times, pa.int64()), pa.array(sums, pa.int64())], ["row_key", "piece", "times", "known"])
                    keys, pieces, times, sums = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pieces, pa.string()), pa.array(times, pa.int64()), pa.array(sums, pa.int64())], ["row_key", "piece", "times", "known"])

    # Rows equal in id and text are counted once.
    rows = docs.select(row_key(identity, text).alias("row_key"), F.col(identity).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    filled = docs.filter(F.col(text) != "").select(row_key(identity, text).alias("row_key"), text)
    parts = filled.mapInArrow(summed, "row_key long, piece string, times long, known long")
    totals = (
        parts.join(known.select("piece", "tokens"), "piece", "left")
        .groupBy("row_key").agg(
            F.sum(F.col("times") * F.coalesce("tokens", F.lit(0)) + F.col("known")).alias("sum"),
        )
    )
    copies = rows.groupBy("row_key").agg(F.count("*").alias("copies"))
    n_tokens = F.coalesce((F.col("sum") / F.col("copies")).cast("long"), F.lit(0))
    return (
        rows.join(totals.join(copies, "row_key"), "row_key", "left")
        .withColumn("n_tokens", n_tokens.cast("long"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
