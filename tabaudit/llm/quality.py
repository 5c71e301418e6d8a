"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own and its neighbours' features;
labels of neighbouring lines depend on each other.  Training sees the document
label on every line of a bounded sample of labelled documents.  A document's
quality is the mean of its lines' good marginals, weighted by length, passed
through a two-number calibration fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import nullable

# Bound of the training sample, in documents.
TRAIN_DOCUMENTS = 3000
STEPS = 150
# Whole documents are scored together up to about this many bytes.
CHUNK = 1 << 20

FEATURES = 16
# Byte classes: upper case, lower case, digit, blank, end of sentence, "!", vertical bar, other signs, beyond ASCII.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 8
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?"]] = 4
_CLASS[ord("!")], _CLASS[ord("|")] = 5, 6
_CLASSES = 9


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of own, previous and next line's features, for "good"
    moves: np.ndarray  # 2 x 2, log potentials from label to label
    first: np.ndarray
    slope: float
    shift: float


def lines_of(text: str | None) -> list[bytes]:
    """Lines with any word; a text without words is one empty line."""
    return [x for x in (text or "").encode("utf-8", "replace").split(b"\n") if x.strip()] or [b""]


def line_features(lines: list[bytes]) -> np.ndarray:
    """One row of features per line, all about between 0 and 1."""
    size = np.array([len(x) for x in lines])
    out = np.zeros((len(lines), FEATURES), np.float32)
    codes = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    at = np.repeat(np.arange(len(lines)), size)
    counts = np.bincount(at * _CLASSES + codes, minlength=len(lines) * _CLASSES).reshape(-1, _CLASSES)
    out[:, :_CLASSES] = counts / np.maximum(size, 1)[:, None]
    out[:, 0] = counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            out[i, 9] = len(set(words)) / n
            out[i, 10] = sum(map(eq, words, words[1:])) / n
            out[i, 11] = min((size[i] - n + 1) / n / 10, 2)
            out[i, 12] = min(np.log1p(n) / 6, 2)
            out[i, 13] = n <= 3
            out[i, 14] = min(sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n, 1)
    out[:, 15] = 1
    return out


def with_neighbours(features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of the line, the one before and the one after in the same document (zero at the ends)."""
    starts = np.cumsum(sizes) - sizes
    before, after = np.roll(features, 1, 0), np.roll(features, -1, 0)
    before[starts] = 0
    after[starts + sizes - 1] = 0
    return np.concatenate([features, before, after], 1)


def chains(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """Forward-backward over all documents at once: (log Z per document, good marginals, expected moves)."""
    order = np.argsort(-sizes, kind="stable")
    starts, longest = (np.cumsum(sizes) - sizes)[order], int(sizes.max())
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # documents longer than t
    emit = np.stack([np.zeros_like(scores), scores], 1)
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    join = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    for t in range(longest):
        at = starts[: active[t]] + t
        alpha[at] = emit[at] + (first if t == 0 else join((alpha[at - 1][:, :, None] + moves).swapaxes(1, 2)))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        beta[at] = join(moves + (emit[at + 1] + beta[at + 1])[:, None, :])
    total = join(alpha[np.cumsum(sizes) - 1])
    every = np.repeat(total, sizes)
    good = np.exp(alpha[:, 1] + beta[:, 1] - every)
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(sizes) - 1] = False
    at = np.flatnonzero(inner)
    pair = alpha[at][:, :, None] + moves + (emit[at + 1] + beta[at + 1])[:, None, :] - every[at][:, None, None]
    return total, good, np.exp(pair).sum(0)


def _weighted(good: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(features: np.ndarray, sizes: np.ndarray, weight: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Fit by Adam on the mean log likelihood per line with a small ridge; then calibrate by Newton steps."""
    x = with_neighbours(features, sizes).astype(np.float64)
    y = np.repeat(labels, sizes).astype(np.float64)
    starts, n = np.cumsum(sizes) - sizes, len(y)
    same = np.array([[((labels == 0) * (sizes - 1)).sum(), 0], [0, ((labels == 1) * (sizes - 1)).sum()]], float)
    begun = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    theta = np.zeros(x.shape[1] + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, moves, first = theta[: x.shape[1]], theta[-6:-2].reshape(2, 2), theta[-2:]
        _, good, moved = chains(x @ w, sizes, moves, first)
        opened = np.array([(1 - good[starts]).sum(), good[starts].sum()])
        slope = np.concatenate([x.T @ (y - good), (same - moved).ravel(), begun - opened]) / n - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, moves, first = theta[: x.shape[1]], theta[-6:-2].reshape(2, 2), theta[-2:]
    q = _weighted(chains(x @ w, sizes, moves, first)[1], weight, sizes) - 0.5
    a, b = 4.0, 0.0
    for _ in range(20):
        p = _sigmoid(a * q + b)
        d = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((labels - p) * q).sum() - 0.1 * (a - 4), (labels - p).sum() - 0.1 * b])
        hess = np.array([[(d * q * q).sum() + 0.1, (d * q).sum()], [(d * q).sum(), d.sum() + 0.1]])
        a, b = np.clip(np.array([a, b]) + np.linalg.solve(hess, grad), [1, -20], [40, 20])
    return Model(w, moves, first, float(a), float(b))


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    lines, sizes = [], []
    for text in texts:
        own = lines_of(text)
        lines += own
        sizes.append(len(own))
    sizes = np.array(sizes)
    weight = np.array([len(x) + 1.0 for x in lines])
    x = with_neighbours(line_features(lines), sizes)
    good = chains(x @ model.weights, sizes, model.moves, model.first)[1]
    return _sigmoid(model.slope * (_weighted(good, weight, sizes) - 0.5) + model.shift)


def held_out(identity: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCUMENTS) -> Model:
    """Train on at most ``most`` labelled documents that are not held out, the first by hash of their id.

    Rows with a null id or label are left out, as are ids with two labels.
    Without documents of both labels the model scores every text 0.5.
    """
    known = (
        labels.filter(F.col(identity).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(identity)))
        .groupBy(identity).agg(F.min(label).alias("_low"), F.max(label).alias("_label")).filter("_low = _label")
    )
    chosen = known.orderBy(F.xxhash64(F.col(identity).cast("string")), identity).limit(most).select(F.col(identity).alias("_id"), "_label")

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [lines_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([line_features(x).tobytes() for x in lines], pa.binary()),
                pa.array([np.array([len(y) + 1 for y in x], np.int64).tobytes() for x in lines], pa.binary()),
            ], ["label", "features", "weight"])

    # ``chosen`` has at most ``most`` rows of two numbers.
    rows = docs.join(F.broadcast(chosen), F.col(identity) == F.col("_id")).select(F.col("_label").cast("int"), text)
    found = rows.mapInArrow(prepared, "label int, features binary, weight binary").toArrow().to_pydict()
    y = np.array(found["label"], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(3 * FEATURES), np.zeros((2, 2)), np.zeros(2), 1.0, 0.0)
    weights = [np.frombuffer(b, np.int64) for b in found["weight"]]
    features = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["features"]])
    return train(features, np.array([len(w) for w in weights]), np.concatenate(weights).astype(float), y)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a ``score`` column: 0 to 1, higher is better.

    Only the text is looked at.  A null, empty or blank text is one empty
    line and gets the model's score for it.  Any length is read whole; ties,
    repeated rows and other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, out = batch.column(batch.schema.get_field_index(text)), 0, []
            chunk, size = [], 0
            for value in texts:
                chunk.append(value.as_py())
                size += len(chunk[-1] or "")
                if size >= CHUNK:
                    out.append(score_texts(shared.value, chunk))
                    chunk, size = [], 0
            if chunk:
                out.append(score_texts(shared.value, chunk))
            yield batch.append_column("score", pa.array(np.concatenate(out) if out else np.empty(0), pa.float64()))

    schema = nullable(docs.select(*keep)).add("score", "double")
    return docs.select(*keep).mapInArrow(scored, schema)


def judge(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: (doc_id, held_out, score, predicted); see ``fit`` and ``score``."""
    model = fit(docs, labels, identity, text, **options)
    return score(docs.select(F.col(identity).alias("doc_id"), F.col(text).alias("text")), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least 0.5."""
    text = options.get("text", "text")
    model = fit(docs, labels, **options)
    kept = docs.columns
    return score(docs, model, text).filter(F.col("score") >= 0.5).select(*kept)
