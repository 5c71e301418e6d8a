"""Records of delimited text with line breaks inside quotes, read in splits.

A split of a file does not know whether it begins inside a quoted value.
Every line maps both possible states to the states after it, so a split's
lines compose to one such map, and running over the maps of a file's splits
gives each split its true state.  Then every split joins its lines to
records; what is left open at a split's end is stitched to the next ones'
beginnings.  No file is read by one task, however many line breaks its values
hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.operators.scale import BROADCAST_ROWS, materialize

# Encodings in which line feed, quote and separators are the bytes of ASCII, and which any bytes can be read as.
ASCII_BASED = ("ISO-8859-1", "UTF-8")

# Maps of (outside, inside) to states: 0 always outside, 1 the other one, 2 the same, 3 always inside.
_OUT, _SWAP, _SAME, _IN = range(4)


def splittable(encoding: str) -> bool:
    return encoding.upper() in ASCII_BASED


def with_turns(lines: DataFrame, sep: str) -> DataFrame:
    """``lines`` with ``turn``, the map of states of each line; most lines hold no quote and change nothing.

    A quote opens a value only where a field begins, ends it unless another
    quote follows, and is an ordinary character elsewhere.
    """
    mark = "'" + sep.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def step(state: str) -> str:
        return f"""CASE {state} WHEN 1 THEN if(_parts[i] = '', 2, 0) WHEN 2 THEN 1
          ELSE if(endswith(_parts[i - 1], {mark}) OR (i = 1 AND _parts[0] = ''), 1, 0) END"""

    # States: 0 outside, 1 inside, 2 at a quote that ends the value unless another follows at once.
    folded = f"""aggregate(sequence(1, size(_parts) - 1), named_struct('a', 0, 'b', 1),
      (s, i) -> named_struct('a', {step("s.a")}, 'b', {step("s.b")}), s -> if(s.a = 1, 1, 0) + if(s.b = 1, 2, 0))"""
    parts = F.when(F.contains("line", F.lit('"')), F.split("line", '"', -1))
    return lines.withColumn("_parts", parts).withColumn("turn", F.expr(f"cast(if(_parts IS NULL, {_SAME}, {folded}) as tinyint)")).drop("_parts")


def lines_of(spark: SparkSession, path: str | Sequence[str], encoding: str) -> DataFrame:
    """(file, block, line): every physical line with its file and the start of its split.

    Lines end at line feeds only, so a carriage return inside a value stays.
    """
    text = F.make_valid_utf8("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("line")
    )


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One map per split from the maps of its lines in order."""
    at, last = None, _SAME
    done: list[tuple[int, int, int]] = []
    for batch in batches:
        file, block, turn = (np.asarray(c) for c in batch.columns)
        begins = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (block[1:] != block[:-1]))) if len(turn) else []
        for s, e in zip(begins, np.append(begins[1:], len(turn))):
            if at != (file[s], block[s]):
                if at is not None:
                    done.append((*at, last))
                at, last = (file[s], block[s]), _SAME
            part = turn[s:e]
            # Only what follows the last line of fixed outcome counts.
            fixed = np.flatnonzero((part == _OUT) | (part == _IN))
            if len(fixed):
                last = int(part[fixed[-1]])
                part = part[fixed[-1] + 1 :]
            if int((part == _SWAP).sum()) % 2:
                last = _IN - last
    if at is not None:
        done.append((*at, last))
    columns = list(zip(*done)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int8())], ["file_key", "block", "turn"]
    )


def split_states(turned: DataFrame) -> DataFrame:
    """(file_key, block, open): is a quoted value open where the split begins?  One row per split."""
    narrow = turned.select(F.xxhash64("file").alias("file_key"), "block", "turn")
    maps = materialize(narrow.mapInArrow(_composed, "file_key long, block long, turn tinyint"), "splits")
    before = Window.partitionBy("file_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file_key").orderBy("block")
    # The state is the last fixed outcome, turned over by every exchange since.
    swaps = F.count_if(F.col("turn") == _SWAP)
    fixed = F.when(F.col("turn").isin(_OUT, _IN), F.struct((F.col("turn") == _IN).cast("int").alias("state"), F.col("_swaps").alias("swaps")))
    told = maps.withColumn("_swaps", swaps.over(upto)).withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before)).withColumn("_before", F.coalesce(swaps.over(before), F.lit(0)))
    since = F.col("_before") - F.coalesce("_fixed.swaps", F.lit(0))
    return told.select("file_key", "block", ((F.coalesce("_fixed.state", F.lit(0)) + since) % 2).cast("tinyint").alias("open"))


# A record in one piece, the rest of one begun earlier, a split inside one, a beginning.
_WHOLE, _REST, _INNER, _BEGUN = range(4)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, kind, first, record) of the lines of whole splits in order."""
    out: list[tuple[str, int, int, bool, str]] = []
    held: list[str] = []
    at, state, size, began, first = None, 0, 0, True, True

    def close(kind: int) -> None:
        nonlocal first, size
        if held:
            text = "\n".join(held)
            blank = not text.strip("\r\n")
            out.append((*at, kind, first and at[1] == 0 and not blank, text))
            size += len(text)
            first = first and blank
            held.clear()

    def flush() -> pa.RecordBatch:
        nonlocal size
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int8(), pa.bool_(), pa.string()]
        out.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "kind", "first", "record"])

    for batch in batches:
        for file, block, opened, turn, line in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (file, block):
                # What is open here goes on in the next split.
                close(_BEGUN if began else _INNER)
                at, state, began, first = (file, block), opened, not opened, True
            if not state:
                began = True
            held.append(line)
            state = turn >> state & 1
            if not state:
                close(_WHOLE if began else _REST)
                began = True
            if size > 1 << 22:
                yield flush()
    if at is not None:
        close(_BEGUN if began else _INNER)
    yield flush()


def records(spark: SparkSession, path: str | Sequence[str], sep: str, encoding: str, most_splits: int = BROADCAST_ROWS) -> DataFrame:
    """(file, first, record): every record as one text, ``first`` for the first of a file; blank lines outside values go.

    The states of the splits are broadcast up to ``most_splits`` of them;
    beyond, lines are dealt to their states by a join and put in order again.
    A value that is still open at the end of its file ends there.
    """
    turned = with_turns(lines_of(spark, path, encoding), sep)
    states = materialize(split_states(turned), "states")
    keyed = turned.withColumn("file_key", F.xxhash64("file"))
    if states.count() <= most_splits:
        placed = keyed.join(F.broadcast(states), ["file_key", "block"])
    else:
        placed = keyed.withColumn("_place", F.monotonically_increasing_id()).join(states, ["file_key", "block"])
        placed = placed.repartition("file_key", "block").sortWithinPartitions("file_key", "block", "_place")
    pieces = materialize(
        placed.select("file", "block", "open", "turn", "line").mapInArrow(_joined, "file string, block long, kind tinyint, first boolean, record string"), "records"
    )
    # At most two pieces of a split are not whole; a beginning and what follows it up to the rest are one record.
    order = Window.partitionBy("file").orderBy("block", "kind")
    stitched = (
        pieces.where(F.col("kind") != _WHOLE).withColumn("_record", F.count_if(F.col("kind") == _BEGUN).over(order))
        .groupBy("file", "_record")
        .agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("_p"))
        .select("file", "first", F.array_join(F.transform("_p", lambda p: p["record"]), "\n").alias("record"))
    )
    every = pieces.where(F.col("kind") == _WHOLE).select("file", "first", "record").unionByName(stitched)
    return every.where(F.col("record").rlike(r"[^\r\n]"))
