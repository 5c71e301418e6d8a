"""Word rules, row keys and hashing shared by the operators of this package."""

from __future__ import annotations

import string

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

# Small side tables are broadcast only after a count showed at most this many narrow rows.
BROADCAST_ROWS = 500_000

# A worker keeps at most this many word hashes between batches.
CACHED_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_list(text: Column, pattern: str = WORD) -> Column:
    """All words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def row_key(identity: str, text: str) -> Column:
    """Tells rows apart that share an id but not the text; equal rows share the key."""
    return F.xxhash64(F.lit(1), F.col(identity), F.lit(2), F.col(text))


def broadcast_if_small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a narrow table only when its counted rows allow it."""
    return F.broadcast(side) if side.count() <= rows else side


class WordHashes(dict):
    """64-bit hashes of words, remembered for frequent words only as far as memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


# Words of more bytes are hashed one by one, shorter ones eight bytes of all words at a time.
LONG_WORD = 256


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts, its 64-bit hash) of UTF-8 bytes; splits at the same bytes as WORD.

    No object is made for a word.  Words of up to ``LONG_WORD`` bytes chain a
    bijective mix over pieces of eight bytes, seeded by their length.
    """
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (raw == 32) | ((raw - np.uint8(9)) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    # Eight bytes from every place on, beyond the end filled with zeros.
    pieces = np.ndarray((len(raw) + 1,), "<u8", data + bytes(8), strides=(1,))
    # Scattered lengths: zero bytes at the end of a word make another word of it.
    hashes = mixed(size.astype(np.uint64))
    left, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(left):
        rest = size[left] - at
        # Bytes behind the word are cut off.
        cut = np.uint64(8) * np.maximum(8 - rest, 0).astype(np.uint64)
        piece = (pieces[starts[left] + at] << cut) >> cut
        hashes[left] = mixed(hashes[left] ^ piece)
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return starts, hashes


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """The words of a text as UTF-8; splits at the same bytes as WORD."""
    raw = (text or "").encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


def mixed(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` neighbouring words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mixed(out)


def nullable(df: DataFrame) -> T.StructType:
    """A schema of its own in which every column may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
