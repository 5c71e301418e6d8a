"""Rarity of 64-bit tokens over the whole corpus, in a table of fixed size.

Tokens are counted in 2^20 buckets by hash.  The level of a bucket (the power
of two of its count) orders tokens for prefix filters: any order that all rows
share is exact, and frequent tokens never look rare.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 20
CHUNKS = 64
_WIDTH = (1 << BITS) // CHUNKS


def buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BITS)).astype(np.int64)


class Counts:
    """Counts of one task; always 8 MB, and tokens held until there are enough to count at once."""

    HOLD = 1 << 21

    def __init__(self) -> None:
        self.table = np.zeros(1 << BITS, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: np.ndarray) -> None:
        self.held.append(buckets(tokens))
        self.size += len(tokens)
        if self.size >= self.HOLD:
            self._count()

    def _count(self) -> None:
        if self.held:
            self.table += np.bincount(np.concatenate(self.held), minlength=1 << BITS)
            self.held, self.size = [], 0

    def packed(self) -> list[tuple[int, bytes]]:
        self._count()
        parts = self.table.reshape(CHUNKS, _WIDTH)
        return [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(parts) if p.any()]


def levels(parts: DataFrame) -> np.ndarray:
    """Sum the tasks' (chunk, counts) rows per chunk and return the level of every bucket: 1 MB."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(counts), np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int32()),
            pa.array([np.log2(s + 1).astype(np.uint8).tobytes() for s in sums.values()], pa.binary()),
        ], ["chunk", "counts"])

    rows = parts.repartition(CHUNKS, "chunk").mapInArrow(summed, "chunk int, counts binary").toArrow().to_pydict()
    out = np.zeros((CHUNKS, _WIDTH), np.uint8)
    for chunk, level in zip(rows["chunk"], rows["counts"]):
        out[chunk] = np.frombuffer(level, np.uint8)
    return out.ravel()
