"""Line dedup by an exact set-similarity join.

A line is the set of its words, A-Z lowered.  Equal sets collapse first: only
the first line of each set goes on.  Tokens are ordered by rarity; two sets
with Jaccard similarity of at least the threshold share a token of their
prefixes, differ little in length, and meet early enough in both.  Candidates
are verified on whole sets of 32-bit token hashes: two words of a compared pair
are taken for one with probability 2^-32.  A line is removed if an earlier one matches it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import BROADCAST_ROWS, broadcast_if_small, hashed_words, mixed, nullable, row_key
from tabaudit.llm.rarity import BITS, Counts, levels
from tabaudit.operators.scale import materialize, split_hot_keys

THRESHOLD = 80  # per cent
CHUNK = 1 << 19
# Buckets of up to so many postings are searched for possible pairs at once; larger ones go on whole.
BUCKET = 1 << 14
# So many pairs for each posting are handed on; buckets with more (groups of near copies) go on whole.
PAIRS = 4
HELD = 1 << 16
# Wide hash classes tell long sets apart: 64 for each of these columns.
WIDE = ["w0", "w1", "w2", "w3"]
# Tokens seen 2^14 times or more may have large buckets: their postings are spread over tasks and go on whole.
HOT_LEVEL = 14
SPREAD = 64
# Postings of a bucket that are compared by one task at most with as many others.
BLOCK = 1 << 13
# Slices of a crowded bucket's sets, and where the first rounds of comparisons end; sets that found a match leave after each.
SLICES = 32
ROUNDS = (1, 8, SLICES)
# Sets with more than one in so many of all lines are joined by broadcast: there can be no more than so many.
COMMON = 1000


def _chunks(values: Iterator[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Whole texts in groups of about ``CHUNK`` characters, with the place of the first."""
    at, held, size = 0, [], 0
    for i, value in enumerate(values):
        held.append(value)
        size += len(value or "")
        if size >= CHUNK:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


# Lines of a chunk are numbered with so many bits when words are sorted; chunks with more take the slower sort.
LINE_BITS = 17


def token_sets(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Sets of all worded lines: (text no, line no, set size, digest, tokens of all lines one after the other)."""
    data = "\n".join([t or "" for t in texts]).encode("utf-8", "replace").lower()
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    starts, tokens = hashed_words(data)
    line = np.searchsorted(feeds, starts)
    if len(feeds) >> LINE_BITS:
        order = np.lexsort((tokens, line))
    else:
        # One number for both; words of a line that agree in all but the last bits are one word but for a chance of 2^-47.
        order = np.argsort((line.astype(np.uint64) << np.uint64(64 - LINE_BITS)) | (tokens >> np.uint64(LINE_BITS)))
    tokens, line = tokens[order], line[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (tokens[1:] != tokens[:-1])
    tokens, line = tokens[new], line[new]
    begins = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
    size = np.diff(np.r_[begins, len(line)]).astype(np.int32)
    digest = mixed(np.add.reduceat(mixed(tokens), begins) + size.astype(np.uint64)) if len(size) else np.empty(0, np.uint64)
    # Texts are joined by one line feed, so each begins a line.
    first = np.cumsum([0] + [1 + (t or "").count("\n") for t in texts[:-1]])
    doc = np.searchsorted(first, line[begins], side="right") - 1
    return doc, (line[begins] - first[doc]).astype(np.int32), size, digest.view(np.int64), tokens


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """One scan of the texts: all worded lines, their token sets, and the rarity levels.

    Lines are (doc_id, row_key, line, digest); sets are (digest, n, bits,
    more, tokens) with tokens as 32-bit hashes, each set at least once.
    ``bits`` and ``more`` are the 128 hash classes that the tokens fall into.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, kind = Counts(), set(), None
        names = ["doc_id", "row_key", "line", "n", "digest", "bits", "more", "tokens", "chunk", "counts"]
        for batch in batches:
            kind = batch.column(0).type
            for at, texts in _chunks(v.as_py() for v in batch.column(2)):
                doc, number, size, digest, tokens = token_sets(texts)
                counts.add(tokens)
                # A set that this task has already handed on is not repeated; forgetting some only costs rows.
                if len(seen) > 200_000:
                    seen.clear()
                fresh = [not (d in seen or seen.add(d)) for d in digest.tolist()]
                ends = np.cumsum(size)
                small = (tokens >> np.uint64(32)).astype(np.uint32)
                bit = np.uint64(1) << (tokens & np.uint64(63))
                high = (tokens & np.uint64(64)) > 0
                bits, more = (np.bitwise_or.reduceat(np.where(on, bit, np.uint64(0)), ends - size) if len(size) else bit for on in (~high, high))
                packed = [small[e - n : e].tobytes() if new else None for e, n, new in zip(ends.tolist(), size.tolist(), fresh)]
                rows, none = pa.array(doc + at), len(doc)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number), pa.array(size), pa.array(digest),
                    pa.array(bits.view(np.int64)), pa.array(more.view(np.int64)), pa.array(packed, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()),
                ], names)
        if kind is not None:
            parts = counts.packed()
            n = len(parts)
            empty = [pa.nulls(n, t) for t in (kind, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([c for c, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names)

    schema = nullable(docs.select("doc_id"))
    for name, kind in (("row_key", "long"), ("line", "integer"), ("n", "integer"), ("digest", "long"), ("bits", "long"), ("more", "long"), ("tokens", "binary"), ("chunk", "integer"), ("counts", "binary")):
        schema = schema.add(name, kind)
    found = materialize(docs.select("doc_id", "row_key", "text").mapInArrow(read, schema), "lines")
    level = levels(found.filter("chunk IS NOT NULL").select("chunk", "counts"))
    return (
        found.filter("chunk IS NULL").select("doc_id", "row_key", "line", "digest"),
        found.filter("tokens IS NOT NULL").select("digest", "n", "bits", "more", "tokens"), level,
    )


# One number holds token and set size, so that one column sorts by both.
POSTING = "key long, salt int, digest long, bits long, more long, pos int"
SIZE_BITS = 31
# A rarity level is the power of two of a count below 2^63.
LEVEL_BITS = 6


def _postings(sets: DataFrame, level: np.ndarray, threshold: int) -> DataFrame:
    """Prefix tokens of the sets, see ``POSTING``; the salt is 0 but for hot tokens."""
    shared = sets.sparkSession.sparkContext.broadcast(level)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(1).to_numpy().astype(np.int64)
            tokens = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32)
            line = np.repeat(np.arange(len(size)), size)
            # Line, rarity level and token in one number: sorted, it holds the tokens of each line in rarity order.
            ranked = (line.astype(np.uint64) << np.uint64(32 + LEVEL_BITS)) | (shared.value[tokens >> (32 - BITS)].astype(np.uint64) << np.uint64(32)) | tokens
            ranked.sort()
            pos = np.arange(len(tokens)) - (np.cumsum(size) - size)[line]
            # What a set must share with any similar one leaves this many tokens to look at.
            keep = pos < (size + size * threshold // -100 + 1)[line]
            own, token = pa.array(line[keep]), ranked[keep].astype(np.uint32)
            digest = batch.column(0).to_numpy()[line[keep]]
            salt = np.where(shared.value[token >> (32 - BITS)] >= HOT_LEVEL, 1 + digest % SPREAD, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array((token.astype(np.int64) << SIZE_BITS) | size[line[keep]]), pa.array(salt.astype(np.int32)),
                pa.array(digest), batch.column(2).take(own), batch.column(3).take(own), pa.array(pos[keep].astype(np.int32)),
            ], ["key", "salt", "digest", "bits", "more", "pos"])

    return sets.select("digest", "n", "bits", "more", "tokens").mapInArrow(read, POSTING)


def possible_pairs(token: np.ndarray, digest: np.ndarray, n: np.ndarray, bits: list[np.ndarray], pos: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Possible pairs of postings, ordered by (token, n), of one token and different digests: (one, two, crowded).

    A bucket with more than ``PAIRS`` pairs for each of its postings is
    crowded: it has no pairs in the answer, and ``crowded`` marks its postings.
    """
    bucket = np.cumsum(np.r_[False, token[1:] != token[:-1]])[: len(token)]
    room = np.bincount(bucket) * PAIRS
    found, left = np.zeros(len(room), np.int64), n - pos
    ones, twos = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step = np.arange(len(token)), 1
    while True:
        at = at[at + step < len(token)]
        to = at + step
        # Sizes only grow along a bucket: who is too short or too late for this partner is so for all later ones.
        on = (token[at] == token[to]) & (n[at] * 100 >= n[to] * threshold) & (left[at] * (100 + threshold) >= (n[at] + n[to]) * threshold)
        at, to = at[on], to[on]
        if not len(at):
            break
        # Tokens less the classes that the other set lacks bound the intersection.
        lacks = lambda p, q: sum(np.bitwise_count(b[p] & ~b[q]).astype(np.int64) for b in bits)
        most = np.minimum(left[to], np.minimum(n[at] - lacks(at, to), n[to] - lacks(to, at)))
        fits = np.flatnonzero((most * (100 + threshold) >= (n[at] + n[to]) * threshold) & (digest[at] != digest[to]))
        if len(fits):
            ones.append(at[fits])
            twos.append(to[fits])
            np.add.at(found, bucket[at[fits]], 1)
            at = at[found[bucket[at]] <= room[bucket[at]]]
        step += 1
    one, two, full = np.concatenate(ones), np.concatenate(twos), found > room
    stay = ~full[bucket[one]]
    return one[stay], two[stay], full[bucket]


def _met(postings: DataFrame, threshold: int) -> DataFrame:
    """What may match, with one shuffle: possible pairs, and postings where pairs would be too many.

    Rows with ``other`` are pairs of the digests (digest, other).  The rest
    are postings (token, digest, n, bits, more, pos) of hot tokens, of buckets above
    ``BUCKET`` and of crowded buckets, so that no task holds or compares more
    than that; the joins that follow decide.
    """
    names = ["token", "digest", "n", "bits", "more", "pos", "other"]

    def opened(table: pa.Table, keep: np.ndarray | None = None) -> list[pa.RecordBatch]:
        table = table if keep is None else table.filter(pa.array(keep))
        key = table.column(0).to_numpy()
        n = (key & ((1 << SIZE_BITS) - 1)).astype(np.int32)
        columns = [key >> SIZE_BITS, table.column(2), n, table.column(3), table.column(4), table.column(5), pa.nulls(len(key), pa.int64())]
        return pa.table(columns, names).to_batches()

    def chosen(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # A set that several tasks handed on counts once.
        order = np.lexsort((table.column(2).to_numpy(), table.column(0).to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        key, salt, digest, bits, more, pos = (table.column(i).to_numpy() for i in range(6))
        again = np.r_[False, (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])]
        token, n = key >> SIZE_BITS, key & ((1 << SIZE_BITS) - 1)
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[starts, len(token)])
        whole = (salt > 0) | np.repeat(size > BUCKET, size)
        ask = np.flatnonzero(~whole & ~again)
        both = [b[ask].view(np.uint64) for b in (bits, more)]
        one, two, crowded = possible_pairs(token[ask], digest[ask], n[ask], both, pos[ask].astype(np.int64), threshold)
        whole[ask] = crowded
        yield from opened(table, whole & ~again)
        one, two = digest[ask[one]], digest[ask[two]]
        none = [pa.nulls(len(one), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())]
        columns = [none[0], np.minimum(one, two), *none[1:], np.maximum(one, two)]
        yield from pa.table(columns, names).to_batches()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, large = [], 0, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
            if not rows or (batch is not None and rows < HELD):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            token = table.column(0).to_numpy() >> SIZE_BITS
            # What goes on of a large bucket is not held back.
            begun = 0 if large is None else int(np.searchsorted(token, large, side="right"))
            if begun:
                yield from opened(table.slice(0, begun))
            table, token = table.slice(begun), token[begun:]
            held, rows = [], 0
            if not len(token):
                continue
            # The last bucket may go on in the next batch.
            large, cut = None, int(np.searchsorted(token, token[-1])) if batch is not None else len(token)
            if len(token) - cut > BUCKET:
                large = int(token[-1])
                yield from opened(table.slice(cut))
            else:
                held, rows = table.slice(cut).to_batches(), len(token) - cut
            if cut:
                yield from chosen(table.slice(0, cut).combine_chunks())

    dealt = postings.repartition(F.shiftright("key", SIZE_BITS), "salt").sortWithinPartitions("key")
    return dealt.mapInArrow(read, "token long, digest long, n int, bits long, more long, pos int, other long")


def _signed(sets: DataFrame) -> DataFrame:
    """Sets (digest, n, tokens) with the 256 hash classes that their tokens fall into, see ``WIDE``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(1).to_numpy().astype(np.int64)
            kind = (np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)
            bit, word, starts = np.uint64(1) << (kind & 63).astype(np.uint64), kind >> 6, np.cumsum(size) - size
            wide = [np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), starts) for w in range(len(WIDE))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(w.view(np.int64)) for w in wide)], ["digest", "n", "tokens", *WIDE])

    return sets.select("digest", "n", "tokens").mapInArrow(read, "digest long, n int, tokens binary, " + ", ".join(f"{w} long" for w in WIDE))


def _late(pairs: DataFrame, near: DataFrame, threshold: int) -> DataFrame:
    """The later digest of each pair (x, y) whose sets reach the threshold, by exact counts.

    ``near`` holds (digest, n, tokens, first) and ``WIDE`` of every set in
    question.  Hash classes bound a pair before its tokens are moved.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x, y = set(np.frombuffer(s, np.uint32).tolist()), np.frombuffer(t, np.uint32).tolist()
                both = len(x.intersection(y))
                good.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0]).filter(pa.array(good, pa.bool_()))

    named = lambda end, *columns: near.select(F.col("digest").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
    # Dealt by x, repeated pairs meet and the join needs no second shuffle.
    sized = pairs.repartition("x").dropDuplicates(["x", "y"]).join(named("x", "n", *WIDE), "x")
    alone = lambda p, q: sum((F.bit_count(F.col(f"{w}_{p}").bitwiseAND(F.bitwise_not(F.col(f"{w}_{q}")))) for w in WIDE), F.lit(0))
    most = F.least(F.col("n_x") - alone("x", "y"), F.col("n_y") - alone("y", "x"))
    possible = sized.join(named("y", "n", "tokens", "first", *WIDE), "y").filter(most * (100 + threshold) >= (F.col("n_x") + F.col("n_y")) * threshold)
    whole = possible.select("x", "y", "tokens_y", "first_y").join(named("x", "tokens", "first"), "x")
    later = F.when(F.col("first_y") < F.col("first_x"), F.col("x")).otherwise(F.col("y"))
    return whole.select(later.alias("digest"), "tokens_x", "tokens_y").mapInArrow(check, "digest long").distinct()


def _possible(a: str, b: str, threshold: int) -> Column:
    """Length, positional and hash-class bounds of two postings of one token."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    alone = lambda p, q: sum((F.bit_count(p(c).bitwiseAND(F.bitwise_not(q(c)))) for c in ("bits", "more")), F.lit(0))
    # Tokens from this one on, and tokens less the classes the other set lacks, bound the intersection.
    most = F.least(x("n") - x("pos"), y("n") - y("pos"), x("n") - alone(x, y), y("n") - alone(y, x))
    return (F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * threshold) & (most * (100 + threshold) >= (x("n") + y("n")) * threshold)


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Lines to remove, (row_key, lines), from (doc_id, row_key, text); see ``dedup_lines``."""
    lines, sets, level = line_classes(docs)
    place = F.struct("doc_id", "row_key", "line")
    classes = materialize(lines.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "classes")
    met = materialize(_met(_postings(sets, level, threshold), threshold), "met")
    pairs = met.filter("other IS NOT NULL").select(F.col("digest").alias("x"), F.col("other").alias("y"))
    posted = met.filter("other IS NULL").drop("other")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("digest")).unionByName(posted.select("digest")).distinct()
    # The few sets in question are found where they lie; a large list of them is joined by shuffle.
    wanted = broadcast_if_small(materialize(wanted, "wanted"))
    asked = sets.join(wanted, "digest", "left_semi").select("digest", "n", "tokens").dropDuplicates(["digest"])
    near = materialize(_signed(asked).join(classes.join(wanted, "digest", "left_semi").select("digest", "first"), "digest"), "near")
    # Where pairs would be too many, first every set against the earliest of each of its buckets: groups of near copies end here.
    crowd = materialize(posted.dropDuplicates(["token", "digest"]).join(near.select("digest", "first"), "digest"), "crowd")
    earliest = F.min(F.struct("first", "digest", "n", "bits", "more", "pos"))
    buckets = crowd.groupBy(F.col("token").alias("_token")).agg(earliest.alias("b"), F.count(F.lit(1)).alias("size"))
    crowd = materialize(split_hot_keys(crowd, buckets, "token", "_token").drop("_token"), "crowd")
    # Only these sets are asked for until the last round.
    close = materialize(near.join(broadcast_if_small(crowd.select("digest").distinct()), "digest", "left_semi"), "close")
    bound = (F.col("b.first") < F.col("a.first")) & _possible("a", "b", threshold)
    pair = [F.col("a.digest").alias("x"), F.col("b.digest").alias("y")]
    settled = materialize(_late(crowd.alias("a").filter(bound).select(*pair), close, threshold), "settled")
    # Then what is left against the other earlier sets, large buckets in blocks.  A set with many matches finds one in a small
    # slice of its bucket and is compared no further; one with few or none meets every slice in the end.
    crowd = crowd.drop("b").withColumn("ways", F.ceil(F.col("size") / BLOCK)).withColumn("slice", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(SLICES)))
    own, every = F.pmod(F.xxhash64("digest"), "ways"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1))
    same = reduce(Column.__and__, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("token", "p", "q")))
    for begun, ended in itertools.pairwise((0, *ROUNDS)):
        rest = crowd.join(settled, "digest", "left_anti").withColumn("p", own).withColumn("q", every)
        met = crowd.filter(F.col("slice").between(begun, ended - 1)).withColumn("q", own).withColumn("p", every)
        others = rest.alias("a").join(met.alias("b"), same & bound).select(*pair).distinct()
        if ended < SLICES:
            settled = materialize(settled.unionByName(_late(others, close, threshold)), "settled")
    late = settled.unionByName(_late(pairs.unionByName(others), near, threshold)).distinct().withColumn("_late", F.lit(True))
    gone = materialize(classes.join(late, "digest", "left").filter("_late OR times > 1"), "gone_sets")
    # At most COMMON sets hold more than one in COMMON lines each; the lines of these stay where they are.
    total = classes.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    common = F.col("times") * COMMON > total
    repeated = F.col("_late").isNotNull() | ~place.eqNullSafe(F.col("first"))
    often = F.broadcast(gone.filter(common))
    marked = lines.join(often, "digest").filter(repeated).select("row_key", "line").unionByName(
        lines.join(often, "digest", "left_anti").join(gone.filter(~common), "digest").filter(repeated).select("row_key", "line")
    )
    return marked.groupBy("row_key").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with lines removed from the text, plus ``n_lines`` and ``n_removed``.

    Lines are split at line feeds; a line's set is its distinct words, A-Z
    lowered.  A line goes if a line before it, by (id, row, place in the
    text), has a set of Jaccard similarity ``threshold`` per cent or more,
    itself removed or not.  Of equal lines the first stays; null ids come
    first.  Lines without words stay and match nothing.  Kept lines are
    joined by line feeds.  A null text stays null and has no lines; an empty
    text is one line without words.  Rows equal in id and text are one
    document.  An empty table gives no rows; other columns stay.
    """
    keyed = docs.withColumn("_row", row_key(identity, text))
    gone = removed_lines(keyed.select(F.col(identity).alias("doc_id"), F.col("_row").alias("row_key"), F.col(text).alias("text")), threshold)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = materialize(gone.select(F.col("row_key").alias("_row"), F.col("lines").alias("_lines")), "gone")
    # The texts stay where they are if the list of removed lines is small, by its rows and its line numbers.
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_lines")), F.lit(0))).first()
    small = max(rows, numbers // 8) <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(gone) if small else gone, "_row", "left")
    at = kept.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for value, lines in zip(batch.column(at), batch.column(len(kept)).to_pylist()):
                value = value.as_py()
                parts = [] if value is None else value.split("\n")
                drop = set(lines or ())
                texts.append(value if not drop else "\n".join(x for i, x in enumerate(parts) if i not in drop))
                total.append(len(parts))
                removed.append(len(drop))
            columns = batch.columns[: len(kept)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*kept, "n_lines", "n_removed"])

    schema = nullable(docs.select(*kept)).add("n_lines", "long").add("n_removed", "long")
    return joined.select(*kept, "_lines").mapInArrow(cut, schema)
