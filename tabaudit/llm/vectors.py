"""Embedding near-dedup with Euclidean p-stable hashing.

Unit vectors are projected on random Gaussian directions and cut into cells of
one width; the cells of a table's directions are its bucket.  Vectors that
share a bucket in any table are compared by exact cosine in double precision.
Equal vectors collapse first.  Pairs are never written: a bucket yields the
number of links per vector and a spanning star of each linked group, and a
pair counts only in the first table that brings it together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import nullable
from tabaudit.llm.graph import components
from tabaudit.operators.scale import materialize

COSINE = 0.9
WIDTH = 2.0
# Sought chance that a pair just at the threshold meets in some table.
RECALL = 0.97
# Unrelated vectors that share a bucket with a vector, per table, at most about this many.
COMPANY = 1000
# Larger buckets are compared block by block, in tasks of their own.
BLOCK = 4000
GROUP_ROWS = 40_000


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two vectors of this distance into one cell."""
    u = width / distance
    normal = 0.5 * (1 + math.erf(-u / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, company: int = COMPANY) -> tuple[int, int]:
    """(directions per table, tables) for n vectors: one rule at every size."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    directions = max(4, round(math.log(max(n / company, 1)) / math.log(1 / far)))
    return directions, math.ceil(math.log(1 - recall) / math.log(1 - near**directions))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(usable flags, unit vectors of the usable rows)."""
    ok, out = np.zeros(len(column), bool), []
    for i, value in enumerate(column):
        if value.is_valid and not value.values.null_count and len(value.values):
            x = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64)
            if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                x = x / top
                ok[i] = True
                out.append(x / np.sqrt(x @ x))
    return ok, out


def cells(vectors: np.ndarray, directions: int, tables: int, width: float, seed: int) -> np.ndarray:
    """Bucket of every vector in every table, as 64-bit numbers (rows x tables)."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    lines = rng.standard_normal((vectors.shape[1], tables * directions))
    cut = np.floor((vectors @ lines + rng.uniform(0, width, tables * directions)) / width).astype(np.int64).view(np.uint64)
    out = np.zeros((len(vectors), tables), np.uint64)
    for j in range(directions):
        out = (out ^ cut.reshape(len(vectors), tables, directions)[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest node of each linked group of 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(x: np.ndarray, keys: np.ndarray, table: int, cosine: float, left: np.ndarray, right: np.ndarray):
    """Linked pairs (i, j) of left x right that share no bucket of an earlier table."""
    close = x[left] @ x[right].T >= cosine
    if left is right:
        close &= np.tri(len(left), k=-1, dtype=bool)
    if close.any():
        for t in range(table):
            close &= keys[left, t][:, None] != keys[right, t][None, :]
    i, j = np.nonzero(close)
    return left[i], right[j]


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, identity: str = "vec_id", embedding: str = "embedding",
    recall: float = RECALL, width: float = WIDTH, seed: int = 7,
) -> DataFrame:
    """Per row: (vec_id, n_links, component_id, kept).

    ``n_links`` counts the other rows found with cosine >= ``cosine``, equal
    vectors included; ``component_id`` is the smallest id reachable, ``kept``
    tells whether it is the row's own.  Null, empty or zero vectors and those
    with null or non-finite components link with nothing; vectors of other
    length are not compared.  Null ids may link, and are never the smallest.
    Repeated rows are vectors of their own.  An empty table gives no rows;
    other columns are ignored.  All pairs found are right; a pair just at the
    threshold is found with probability ``recall``, closer ones more surely.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, _ = unit_rows(batch.column(1))
            raw = [xxhash.xxh3_64_intdigest(v.values.to_numpy(zero_copy_only=False).tobytes()) if good else None for good, v in zip(ok, batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.array([r or 0 for r in raw], np.uint64).view(np.int64), pa.int64(), mask=~ok)],
                ["vec_id", "embedding", "node"],
            )

    chosen = vectors.select(F.col(identity).alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = materialize(chosen.mapInArrow(digests, nullable(chosen).add("node", "long")), "vectors")
    classes = materialize(
        rows.filter("node IS NOT NULL").groupBy("node").agg(
            F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding")
        ), "vector_classes",
    )
    total = classes.count()
    directions, tables = plan(total, cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = unit_rows(batch.column(2))
            sizes = np.array([len(x) for x in found])
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                keys = cells(np.stack([found[i] for i in mine]), directions, tables, width, seed)
                part = batch.take(pa.array(mine))
                packed = pa.array([k.tobytes() for k in keys], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(mine), pa.int32()).fill_null(t), pa.array(keys[:, t] ^ np.int64(size)), *part.columns, packed],
                        ["table", "key", "node", "copies", "embedding", "keys"],
                    )

    kind = dict(classes.dtypes)["embedding"]
    placed = materialize(
        classes.select("node", "copies", "embedding").mapInArrow(
            hashed, f"table int, key long, node long, copies long, embedding {kind}, keys binary"
        ), "buckets",
    )
    sizes = placed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # A crowded bucket is dealt into blocks; each pair of blocks is a group of its own.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    groups = math.ceil(total * tables / GROUP_ROWS)
    dealt = (
        placed.join(sizes.select("table", "key", blocks.alias("blocks")), ["table", "key"])
        .withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .withColumn("group", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("table", "key"), F.lit(groups))).otherwise(-1 - F.abs(F.xxhash64("table", "key", "lo", "hi") / 2).cast("long")))
        .select("group", "table", "key", "lo", "hi", "block", "node", "copies", "embedding", "keys")
    )

    def compared(data: pa.Table) -> pa.Table:
        table, node, copies = (data.column(c).to_numpy() for c in ("table", "node", "copies"))
        keys = np.frombuffer(b"".join(data.column("keys").to_pylist()), np.int64).reshape(-1, tables)
        _, found = unit_rows(data.column("embedding").combine_chunks())
        ids = [data.column(c).to_numpy() for c in ("block", "hi", "lo", "key", "table")]
        order = np.lexsort(ids)
        change = np.flatnonzero(np.any([x[order][1:] != x[order][:-1] for x in ids[1:]], 0)) + 1
        out_node, out_links, out_root = [], [], []
        for part in np.split(order, change):
            if len(part) < 2:
                continue
            x, k, own = np.stack([found[i] for i in part]), keys[part], ids[0][part]
            every = np.arange(len(part))
            if ids[1][part[0]] == ids[2][part[0]]:
                sides = (every,) * 2
            else:
                sides = (every[own == ids[2][part[0]]], every[own == ids[1][part[0]]])
            p, q = linked(x, k, int(table[part[0]]), cosine, *sides)
            if len(p):
                weight = copies[part].astype(float)
                links = np.bincount(p, weight[q], len(part)) + np.bincount(q, weight[p], len(part))
                top = roots(len(part), p, q)
                hit = np.flatnonzero(links)
                out_node.append(node[part][hit])
                out_links.append(links[hit].astype(np.int64))
                out_root.append(node[part][top[hit]])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
        return pa.table({"node": join(out_node), "links": join(out_links), "root": join(out_root)})

    met = materialize(dealt.groupBy("group").applyInArrow(compared, "node long, links long, root long"), "links")
    tree = components(met.select("node", "root"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = materialize(
        classes.select("node", "copies", "low").join(links, "node", "left").join(tree, "node", "left")
        .select("node", "copies", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")),
        "vector_links",
    )
    smallest = of_class.groupBy("root").agg(F.min("low").alias("component"))
    known = of_class.join(smallest, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("links"), "component")
    return rows.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
