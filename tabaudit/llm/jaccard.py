"""N-gram Jaccard join in a metric space: pivots, Voronoi regions, triangle windows.

Equal shingle sets collapse first.  A set can only be linked to one that
shares a token of its rarity-ordered prefix; sets without such a partner leave
at once.  The others gather in regions around pivots, each no farther from
its pivot than the radius of the level.  Members of a region within the link
distance of the pivot are linked through it, so groups of near copies need no
pairs.  Distances are computed on whole sets, after a histogram of 512 hash
classes per set, whose common part is an upper bound of the intersection, has
ruled out pairs that are too far to matter.  Across regions, a set is compared with the pivot of every region that
may hold a partner; it is replicated into the region only if its distance is
at most the link distance plus the region's radius (triangle inequality) and
links found so far do not already connect them.  Regions with replicated
boundary sets are joined again at the next, smaller radius, at last zero, where
each set is its own region and every remaining pair is compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.llm.common import broadcast_if_small, hashed_words, mixed, nullable, rolling, row_key
from tabaudit.llm.graph import components
from tabaudit.llm.rarity import Counts, buckets, levels
from tabaudit.operators.scale import materialize

WORDS = 5
SIMILARITY = 75  # per cent
# Region radii of the levels, in per cent of distance; the last must be zero.
RADII = (25, 0)
# Hash classes of a set's histogram; a count of 255 stands for any larger one.
CLASSES = 512


# Texts are hashed in groups of about so many characters.
GROUP = 1 << 18


def shingle_sets(texts: Iterator[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct shingle hashes; fewer words are one shingle, none give an empty set."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "replace").lower())
        size += len(held[-1]) + 1
        if size >= GROUP:
            yield from _grouped(held, words)
            held, size = [], 0
    yield from _grouped(held, words)


def _grouped(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    starts, hashes = hashed_words(b"\n".join(texts))
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
    # Runs across texts are made, too, but belong to none.
    runs = rolling(hashes, words)
    for begin, end in zip([0, *ends], ends):
        n = end - begin
        own = np.sort(runs[begin : end - words + 1] if n >= words else rolling(hashes[begin:end], n) if n else hashes[:0])
        yield own[np.r_[True, own[1:] != own[:-1]]] if n else own


def set_id(shingles: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int(mixed(np.array([mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def histogram(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each hash class, as bytes."""
    return np.minimum(np.bincount((shingles & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def document_sets(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, row_key, n, node, classes) of all rows, and the rarity levels of shingles; one scan of the texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = Counts(), None
        names = ["doc_id", "row_key", "n", "node", "classes", "chunk", "counts"]
        for batch in batches:
            kind, size, nodes, classes = batch.column(0).type, [], [], []
            for own in shingle_sets((v.as_py() for v in batch.column(2)), words):
                size.append(len(own))
                nodes.append(set_id(own) if len(own) else None)
                classes.append(histogram(own) if len(own) else None)
                counts.add(own)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(nodes, pa.int64()), pa.array(classes, pa.binary()),
                pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary()),
            ], names)
        if kind is not None:
            packed = counts.packed()
            none = len(packed)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(none, kind), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()),
                pa.array([c for c, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary()),
            ], names)

    schema = nullable(docs.select("doc_id", "row_key")).add("n", "long").add("node", "long").add("classes", "binary").add("chunk", "integer").add("counts", "binary")
    found = materialize(docs.select("doc_id", "row_key", "text").mapInArrow(read, schema), "document_sets")
    level = levels(found.filter("chunk IS NOT NULL").select("chunk", "counts"))
    return found.filter("chunk IS NULL").drop("chunk", "counts"), level


def _meetings(docs: DataFrame, level: np.ndarray, words: int, similarity: int) -> DataFrame:
    """Prefix tokens that at least two different sets have: (token, node, n, pos, c).

    ``pos`` is the token's place in the set's rarity order, ``c`` tells how shared the token is.
    Only where a set may meet a similar one its token stays, see ``_partnered``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            tokens, nodes, places, held = [], [], [], 0
            pack = lambda: pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(places)),
            ], ["token", "node", "place"])
            for own in shingle_sets((v.as_py() for v in batch.column(0)), words):
                node = set_id(own) if len(own) else None
                if node is None or node in seen:
                    continue
                # Sets already handed on by this task are not repeated; forgetting them only costs rows.
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                keep = len(own) + (len(own) * similarity) // -100 + 1
                # Sorted hashes stay so within a level.
                tokens.append(own[np.argsort(shared.value[buckets(own)], kind="stable")[:keep]])
                nodes.append(np.full(keep, node, np.int64))
                # Size and place in one number: fewer bytes to shuffle, and an order by size.
                places.append((len(own) << 32) + np.arange(keep, dtype=np.int64))
                held += keep
                if held > 100_000:
                    yield pack()
                    tokens, nodes, places, held = [], [], [], 0
            if tokens:
                yield pack()

    by_token = Window.partitionBy("token")
    met = (
        docs.select("text").mapInArrow(read, "token long, node long, place long").repartition("token")
        .withColumns({"_low": F.min("node").over(by_token), "_high": F.max("node").over(by_token), "c": F.count("*").over(by_token)})
        .filter("_low < _high").dropDuplicates(["token", "node"])
    )
    return _partnered(met, similarity).select("token", "node", *_opened("place"), "c")


def _opened(place: str) -> list[Column]:
    """``n`` and ``pos`` of a place."""
    return [F.shiftright(place, 32).alias("n"), F.col(place).bitwiseAND(0xFFFFFFFF).alias("pos")]


# Sets of nearly the same size that a set is compared with on each side, by size and place.
NEIGHBOURS = 3


def _partnered(met: DataFrame, similarity: int) -> DataFrame:
    """Rows (token, node, place) without those that no similar set can meet first at this token.

    Two similar sets are of similar size, and what follows their first common
    token holds the rest of the intersection.  In order of size, a set is held
    against the next ``NEIGHBOURS`` on each side; if one more is still of
    similar size, the row stays.
    """
    by_size = Window.partitionBy("token").orderBy("place", "node")
    steps = [s for k in range(1, NEIGHBOURS + 2) for s in (-k, k)]
    other = met.withColumns({f"_o{i}": F.lag("place", step).over(by_size) for i, step in enumerate(steps)})
    size, left = F.shiftright("place", 32), F.shiftright("place", 32) - F.col("place").bitwiseAND(0xFFFFFFFF)

    def possible(i: int, step: int) -> Column:
        m = F.shiftright(f"_o{i}", 32)
        alike = F.least(size, m) * 100 >= F.greatest(size, m) * similarity
        rest = F.least(left, m - F.col(f"_o{i}").bitwiseAND(0xFFFFFFFF))
        # Least and greatest pass over nulls.
        return m.isNotNull() & alike & ((rest * (100 + similarity) >= (size + m) * similarity) | F.lit(abs(step) > NEIGHBOURS))

    return other.filter(reduce(Column.__or__, [possible(i, step) for i, step in enumerate(steps)])).select(*met.columns)


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the wanted rows (row_key)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, sets, held = [], [], 0
            # Rows equal in id and text share a key and give one set per task.
            texts = (v.as_py() for row, v in zip(batch.column(0).to_pylist(), batch.column(1)) if not (row in seen or seen.add(row)))
            for own in shingle_sets(texts, words):
                sets.append(own)
                nodes.append(set_id(sets[-1]))
                held += len(sets[-1])
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])
                    nodes, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    chosen = docs.join(broadcast_if_small(wanted), "row_key", "left_semi")
    return chosen.select("row_key", "text").mapInArrow(read, "node long, shingles binary")


class Sets:
    """What is known of the sets that met: histograms, and the rows whose texts give them in whole."""

    def __init__(self, docs: DataFrame, known: DataFrame, words: int, similarity: int) -> None:
        self.docs, self.known, self.words, self.similarity = docs, known, words, similarity

    def measured(self, pairs: DataFrame) -> DataFrame:
        """Written (node, pivot, limit, distance, linked) of the pairs (node, pivot, limit) not surely beyond their limit."""

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES) for c in (5, 6))
                n = batch.column(3).to_numpy() + batch.column(4).to_numpy()
                most = np.minimum(a, b).sum(1, dtype=np.int64)
                near = 1 - most / np.maximum(n - most, 1) <= batch.column(2).to_numpy() + 1e-9
                near |= (a.max(1) == 255) | (b.max(1) == 255)
                yield batch.select([0, 1, 2]).filter(pa.array(near))

        side = lambda name, n, classes: self.known.select(F.col("node").alias(name), F.col("n").alias(n), F.col("classes").alias(classes))
        close = materialize(
            pairs.join(side("node", "_n", "_a"), "node").join(side("pivot", "_m", "_b"), "pivot")
            .select("node", "pivot", "limit", "_n", "_m", "_a", "_b").mapInArrow(possible, "node long, pivot long, limit double"), "close",
        )
        wanted = close.select("node").unionByName(close.select(F.col("pivot").alias("node"))).distinct()
        rows = self.known.join(wanted, "node", "left_semi").select("row_key").distinct()
        sets = materialize(_whole_sets(self.docs, rows, self.words), "sets")
        similarity = self.similarity

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                distance, linked = [], []
                for a, b in zip(batch.column(3), batch.column(4)):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    either = len(x) + len(y) - both
                    distance.append(1 - both / either)
                    linked.append(100 * both >= similarity * either)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())],
                    ["node", "pivot", "limit", "distance", "linked"],
                )

        pivots = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("_p"))
        return materialize(
            close.join(pivots, "pivot").join(sets, "node").select("node", "pivot", "limit", "shingles", "_p")
            .mapInArrow(exact, "node long, pivot long, limit double, distance double, linked boolean").distinct(), "measured",
        )


def _regions(met: DataFrame, sets: Sets, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """Home region of every set, (node, region, distance), and the links seen on the way.

    A set votes for its most shared, its least shared and one chance token;
    the sets of one token have the most central one as pivot, whose tokens are
    shared most often in all: the source of a group of near copies, which is
    near to all of them, rather than one copy.  Of the pivots it voted for, a
    set's home is the nearest within the radius, else it is a region of its
    own.
    """
    nodes = met.select("node").distinct()
    if radius == 0:
        return nodes.select("node", F.col("node").alias("region"), F.lit(0.0).alias("distance")), None
    chance = F.xxhash64("token")
    votes = met.groupBy("node", "n").agg(
        F.array(
            F.max(F.struct("c", chance.alias("h"), "token"))["token"], F.min(F.struct("c", chance.alias("h"), "token"))["token"],
            F.min(F.struct(chance.alias("h"), "token"))["token"],
        ).alias("tokens"),
        F.sum("c").alias("w"),
    ).select("node", "n", "w", F.explode(F.array_distinct("tokens")).alias("token"))
    pivots = votes.groupBy("token").agg(F.max(F.struct("w", F.xxhash64("node").alias("h"), "node", "n")).alias("p"))
    pairs = (
        votes.join(pivots, "token")
        .filter((F.col("node") != F.col("p.node")) & (100 * F.least("n", "p.n") >= (100 - radius) * F.greatest("n", "p.n")))
        .select("node", F.col("p.node").alias("pivot")).distinct().withColumn("limit", F.lit(radius / 100))
    )
    seen = sets.measured(pairs)
    homes = seen.filter(F.col("distance") * 100 <= radius).groupBy("node").agg(F.min(F.struct("distance", "pivot")).alias("h"))
    own = nodes.join(homes, "node", "left").select(
        "node", F.coalesce("h.pivot", "node").alias("region"), F.coalesce("h.distance", F.lit(0.0)).alias("distance")
    )
    return own, seen.filter("linked").select("node", "pivot")


def linked_sets(met: DataFrame, sets: Sets, radii: Sequence[int] = RADII) -> DataFrame:
    """Components (node, root) of the links of at least the sets' similarity among sets that met."""
    if radii[-1] != 0:
        raise ValueError("the last radius must be zero")
    similarity = sets.similarity
    if max(radii) > 100 - similarity:
        raise ValueError("members of a region must link with its pivot")
    far = 1 - similarity / 100
    links, roots = None, None
    for radius in radii:
        homes, seen = _regions(met, sets, radius)
        homes = materialize(homes, "homes")
        if seen is not None:
            links = seen if links is None else links.unionByName(seen)
            roots = components(links)
        reach = homes.groupBy("region").agg(F.max("distance").alias("reach"))
        placed = met.join(homes.join(reach, "region"), "node")
        if roots is not None:
            placed = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        else:
            placed = placed.withColumn("root", F.col("node"))
        # Members of a region share their root with the pivot, as its radius is at most the link distance.
        by_region = placed.groupBy("token", "region").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.first("reach").alias("reach"), F.first("root").alias("root")
        )
        pairs = (
            placed.alias("x").join(by_region.alias("r"), "token")
            # One direction is enough: the set of the smaller region visits the larger one.
            .filter((F.struct("x.reach", "x.region") < F.struct("r.reach", "r.region")) & (F.col("x.root") != F.col("r.root")))
            .filter((F.col("x.n") * 100 >= F.col("r.least") * similarity) & (F.col("r.most") * 100 >= F.col("x.n") * similarity))
            # At the first token two sets share, the intersection is at most what follows in either order.
            .filter(F.least(F.col("x.n") - F.col("x.pos"), F.col("r.rest")) * (100 + similarity) >= (F.col("x.n") + F.col("r.least")) * similarity)
            .select("x.node", F.col("r.region").alias("pivot"), (F.lit(far) + F.col("r.reach")).alias("limit")).distinct()
        )
        visits = sets.measured(pairs)
        found = visits.filter("linked").select("node", "pivot")
        links = materialize(found if links is None else links.unionByName(found), "set_links")
        roots = components(links)
        # Boundary sets: inside the window of a region that they are not yet connected with.
        root = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        window = materialize(
            visits.filter(~F.col("linked") & (F.col("limit") > far + 1e-9) & (F.col("distance") <= F.col("limit") + 1e-9))
            .join(root("node"), "node", "left").join(root("pivot"), "pivot", "left")
            .filter(F.coalesce("node_root", "node") != F.coalesce("pivot_root", "pivot"))
            .select("node", "pivot", "distance"), "window",
        )
        if radius == 0 or window.isEmpty():
            return roots
        inner = window.groupBy(F.col("pivot").alias("region")).agg(F.min("distance").alias("closest"))
        members = homes.join(inner, "region").filter(F.col("distance") >= F.col("closest") - far - 1e-9).select("node")
        # Few sets go on; a large list of them is joined by shuffle.
        near = broadcast_if_small(materialize(window.select("node").unionByName(members).distinct(), "near"))
        met = materialize(met.join(near, "node", "left_semi"), "met")
        sets = Sets(sets.docs, materialize(sets.known.join(near, "node", "left_semi"), "known_sets"), sets.words, similarity)
    return roots


def _rooted(docs: DataFrame, words: int, similarity: int, radii: Sequence[int], identity: str, text: str) -> DataFrame:
    """Per row: (doc_id, row_key, n_shingles, root); a text without shingles has no root."""
    keyed = docs.select(F.col(identity).alias("doc_id"), row_key(identity, text).alias("row_key"), F.col(text).alias("text"))
    rows, level = document_sets(keyed, words)
    met = materialize(_meetings(keyed, level, words, similarity), "met")
    known = materialize(
        rows.join(met.select("node").distinct(), "node", "left_semi").groupBy("node", "n")
        .agg(F.min(F.struct("row_key", "classes")).alias("r")).select("node", "n", "r.row_key", "r.classes"), "known_sets",
    )
    roots = linked_sets(met, Sets(keyed, known, words, similarity), radii)
    return rows.join(roots, "node", "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, radii: Sequence[int] = RADII,
    identity: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: (doc_id, n_shingles, component_id, row_key).

    A set is the distinct word shingles of the whole text, A-Z lowered; fewer
    words than a shingle are one shingle.  Sets link at a Jaccard similarity
    of ``similarity`` per cent or more, decided in whole numbers.
    ``component_id`` is the smallest id reachable by links.  A null, empty or
    blank text has no shingles and no links.  Equal rows are linked; a null
    id is never the smallest unless all are.  An empty table gives no rows;
    other columns are ignored.  Sets are told apart by 64-bit hashes.
    """
    placed = _rooted(docs, words, similarity, radii, identity, text)
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component"))
    return placed.join(smallest, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "row_key"
    )


def one_of_each(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, radii: Sequence[int] = RADII,
    identity: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row of ``docs``, all columns, of each component: that with the smallest id, null ids last.

    Among different texts under that id the smallest ``row_key`` decides.  Rows
    equal in id and text are one document, also without shingles; the one
    with the smallest other columns stays.
    """
    placed = _rooted(docs, words, similarity, radii, identity, text)
    # A text without shingles is a component of its own.
    lone = F.when(F.col("root").isNull(), F.col("row_key"))
    keys = materialize(
        placed.groupBy("root", lone.alias("lone"), "row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "keys"
    )
    kept = keys.groupBy("root", "lone").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"].alias("row_key"))
    kept = kept.select("row_key").withColumn("kept", F.lit(True))
    # Documents that go as a whole, and those of which one row of several stays.
    odd = materialize(
        keys.join(kept, "row_key", "left").filter(F.col("kept").isNull() | (F.col("n") > 1))
        .select(F.col("row_key").alias("_row"), F.col("kept").isNotNull().alias("kept")), "odd_keys",
    )
    keyed = docs.withColumn("_row", row_key(identity, text))
    single = keyed.join(odd.select("_row"), "_row", "left_anti").select(*docs.columns)
    repeated = odd.filter("kept").select("_row")
    if repeated.isEmpty():
        return single
    orderable = [f.name for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    first = keyed.join(broadcast_if_small(repeated), "_row", "left_semi").groupBy("_row").agg(
        F.min_by(F.struct(*docs.columns), F.struct(*orderable)).alias("_first")
    )
    return single.unionByName(first.select("_first.*"))
