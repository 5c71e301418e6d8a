"""Draw documents whose hashed n-grams resemble a target set.

The texts of an Arrow batch are joined with a sentinel that no word holds, so
one regular expression pass finds the words of many texts.  The place of each
word among the texts' offsets tells its text, which masks n-grams that would
cross from one text into the next before they are counted.

Two passes: the buckets of both tables are counted, then every document sums
the gains of its buckets and gets Gumbel noise from its id.  The documents
with the highest scores are drawn without replacement.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.llm.common import broadcast_if_small, row_key
from tabaudit.llm.mixing import _numbered as numbered
from tabaudit.operators.scale import materialize

BUCKETS = 10_000
LONGEST = 2
PERCENT = 25
LEAST_WORDS = 20
SEED = 7

# Words are runs of ASCII letters and digits and of bytes beyond ASCII.
FIND = re.compile(rb"[0-9a-z\x80-\xff]+").finditer
SENTINEL = b"\x00"
# A-Z to a-z; the sentinel's byte inside a text becomes a blank, which ends words as it does.
FOLD = bytes.maketrans(string.ascii_uppercase.encode() + SENTINEL, string.ascii_lowercase.encode() + b" ")

# So many bytes of text are joined, or one longer text; so many words are held at a time.
JOINED = 1 << 20
HELD = 1 << 17


def features(texts: list[bytes], longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in the n-gram, crc32 of n-grams, number of the text of each) of joined texts, block by block."""
    joined = SENTINEL.join(t.translate(FOLD) for t in texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    found = FIND(joined)
    words: list[bytes] = []
    starts: list[int] = []
    while block := list(islice(found, HELD)):
        # The last words of the block before begin n-grams that end in this one.
        known = min(len(words), longest - 1)
        words, starts = words[len(words) - known :], starts[len(starts) - known :]
        words += [m[0] for m in block]
        starts += [m.start() for m in block]
        owner = np.searchsorted(ends, starts, "right")
        codes = list(map(crc32, words))
        yield 1, np.array(codes[known:], np.int64), owner[known:]
        linked = [b" " + w for w in words]
        for n in range(2, longest + 1):
            codes = list(map(crc32, linked[n - 1 :], codes))
            new = max(0, known - n + 1)
            inside = owner[n - 1 :][new:] == owner[: max(0, len(owner) - n + 1)][new:]
            yield n, np.array(codes[new:], np.int64)[inside], owner[n - 1 :][new:][inside]


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of neighbouring rows that are joined."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        raw = (text.as_py() or "").encode("utf-8", "replace")
        if held and size + len(raw) > JOINED:
            yield first, held
            first, held, size = at, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of a whole table per bucket; only ``buckets`` numbers reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _runs(batch.column(0)):
                for _, codes, _ in features(texts, longest):
                    total += np.bincount(codes % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    for r in df.select(text).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target against the raw table."""
    size = len(raw)
    over = (target + 1.0) * float(raw.sum() + size)
    under = (raw + 1.0) * float(target.sum() + size)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def noise(identity: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel number) from the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def score(
    docs: DataFrame, target: DataFrame, identity: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """Per row: (doc_id, row_key, n_words, n_features, weight, score)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, text, buckets, longest)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            rows = batch.num_rows
            words, count, total = (np.zeros(rows, np.int64) for _ in range(3))
            for first, texts in _runs(batch.column(2)):
                part = slice(first, first + len(texts))
                for n, codes, owner in features(texts, longest):
                    met = np.bincount(owner, minlength=len(texts))
                    count[part] += met
                    if n == 1:
                        words[part] += met
                    # Sums of whole numbers below 2**53 are exact in doubles.
                    total[part] += np.bincount(owner, gain[codes % buckets], len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words), pa.array(count), pa.array(total // np.maximum(count, 1))],
                ["doc_id", "row_key", "n_words", "n_features", "weight"],
            )

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[identity].dataType), T.StructField("row_key", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")],
    ])
    rows = docs.select(F.col(identity).alias("doc_id"), row_key(identity, text).alias("row_key"), text)
    return rows.mapInArrow(weighed, schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options
) -> DataFrame:
    """Every row's (doc_id, row_key, n_words, n_features, weight, score, rank).

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100)
    are drawn: the highest scores, ties to the smaller id (null last), equal
    rows in any order.  ``rank`` is 1, 2, ... among them and null for others.
    Null and empty texts have no words, no features and weight 0.  Repeated
    rows are rows of their own.  An empty table gives no rows, an empty target
    weighs by rarity alone.  Texts may be of any length; other columns are ignored.
    """
    spark = docs.sparkSession
    # The number of a row is written with it, so it tells equal rows apart in every later job.
    scored = materialize(score(docs, target, **options).withColumn("_at", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= least_words
    # Weights lie between logarithms of counts and noise between -3.2 and 22.9 thousand: about 100,000 different scores at most.
    counts = scored.filter(fit).groupBy("score").count().collect()
    wanted = percent * sum(r["count"] for r in counts) // 100
    cut, reached = None, 0
    for r in sorted(counts, reverse=True):
        if reached >= wanted:
            break
        cut, reached = r["score"], reached + r["count"]
    columns = [c for c in scored.columns if c != "_at"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*columns, none)
    high = fit & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_at")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(scored.filter(high).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    # One row per range.
    earlier = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = placed.join(broadcast_if_small(offsets), "_range").withColumn("_place", place.cast("long"))
    first = ranked.select(*columns, F.when(F.col("_place") <= wanted, F.col("_place")).alias("rank"))
    return first.unionByName(scored.filter(~high).select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns.

    Options as in ``draw``.  Of rows equal in id and text as many stay as
    were drawn; which of them is open.
    """
    identity, text = options.get("identity", "doc_id"), options.get("text", "text")
    keyed = docs.withColumn("_row", row_key(identity, text))
    drawn = materialize(
        draw(docs, target, **options).groupBy(F.col("row_key").alias("_row"))
        .agg(F.count("*").alias("_all"), F.count("rank").alias("_drawn")).filter("_drawn > 0"), "drawn",
    )
    whole = keyed.join(drawn.filter("_drawn = _all"), "_row").select(*docs.columns)
    # Equal rows have one score and id, so the draw ends inside one such group at most.
    part = drawn.filter("_drawn < _all")
    if part.isEmpty():
        return whole
    some = numbered(keyed.join(broadcast_if_small(part), "_row")).filter("_place <= _drawn")
    return whole.unionByName(some.select(*docs.columns))


# crc32 byte by byte over the eight-step remainders of 0 to 255.
ORACLE = r"""
WITH tables AS (
  SELECT list(list_reduce(range(8)::UBIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, n::UBIGINT) ORDER BY n) AS t
  FROM range(256) r(n)),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row_no, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
lists AS (
  SELECT side, row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM lists),
per_row AS (SELECT side, row_no, f, count(*) AS n FROM grams GROUP BY ALL),
codes AS (
  SELECT f, (xor(list_reduce(list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || hex(encode(f))[2 * i - 1 : 2 * i])::UBIGINT),
    lambda c, b: xor(c >> 8, tables.t[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
  FROM (SELECT DISTINCT f FROM per_row), tables),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t
  FROM per_row JOIN codes USING (f) GROUP BY bucket),
sums AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS g FROM counts, sums),
weights AS (
  SELECT row_no, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight
  FROM per_row JOIN codes USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row_no),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM lists LEFT JOIN weights USING (row_no) WHERE side = 'd'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END::BIGINT AS rank FROM placed"""
