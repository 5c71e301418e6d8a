"""Benchmark decontamination: exact containment of item windows, found by their rarest shingle.

A document's shingles meet the benchmark's shingles first; what meets is
counted over the whole corpus.  Each window joins by its rarest shingle alone
(the necessary prefix of a full containment), the shingle's place fixes where
the window must start, and the run of shingles from there must equal the
window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.llm.common import ascii_lower, broadcast_if_small, row_key, word_list
from tabaudit.operators.scale import materialize

# Letters a-z, digits and everything beyond ASCII, after lower-casing A-Z.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
# Narrow benchmark shingles up to this count are broadcast; beyond, the join shuffles.
BROADCAST_SHINGLES = 2_000_000


def item_words(text: Column) -> Column:
    return word_list(ascii_lower(text), ITEM_WORD)


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.element_at(words, at + j) for j in range(1, size + 1)])


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; the run that starts at word i is element i."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(starts, lambda i: _shingle(words, i, size)))


def item_windows(items: DataFrame, window: int, shingle: int, item: str, text: str) -> DataFrame:
    """Distinct windows: (window_id, length, size, shingles, items); items without words have none."""
    words = items.select(F.col(item).cast("string").alias("item"), item_words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    cut = (
        words.withColumn("length", F.least(F.size("words"), F.lit(window)))
        .select("item", "words", "length", F.explode(starts).alias("at"))
        .select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("words"))
    )
    hashes = F.coalesce(*[F.when(F.least("length", F.lit(shingle)) == k, _shingles(F.col("words"), k)) for k in range(1, shingle + 1)])
    return cut.groupBy("words", "length").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64("words").alias("window_id"), "length", F.least("length", F.lit(shingle)).alias("size"), hashes.alias("shingles"), "items"
    )


def occurrences(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
    identity: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Every place where an item window occurs: (row_key, start, length, items); ``start`` counts from 0."""
    windows = materialize(item_windows(items, window, shingle, item, item_text), "windows")
    # At most ``shingle`` values: the shingle sizes that short items call for.
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    tokens = windows.select("window_id", "size", "length", F.posexplode("shingles").alias("offset", "h"))
    known = broadcast_if_small(tokens.select("h").distinct(), BROADCAST_SHINGLES)
    words = docs.select(row_key(identity, text).alias("row_key"), item_words(F.col(text)).alias("words"))
    found = None
    for size in sizes:
        part = words.select("row_key", F.posexplode(_shingles(F.col("words"), size)).alias("at", "h")).join(known, "h", "left_semi").withColumn("size", F.lit(size))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "row_key long, start int, length int, items array<string>")
    # Rows equal in id and text share their key, so their hits are one.
    found = materialize(found, "shingle_hits").dropDuplicates(["row_key", "size", "at", "h"])
    seen = found.groupBy("h").agg(F.count("*").alias("n"))
    # The rarest shingle of each window; a window with a shingle that occurs nowhere cannot occur.
    prefix = (
        tokens.join(seen, "h").groupBy("window_id")
        .agg(F.count("*").alias("known"), F.min(F.struct("n", "h", "offset")).alias("rare"))
        .join(windows, "window_id").filter(F.col("known") == F.size("shingles"))
        .select(F.col("rare.h").alias("h"), F.col("rare.offset").alias("offset"), "size", "length", "shingles", "items")
    )
    following = Window.partitionBy("row_key", "size").orderBy("at").rowsBetween(0, window - 1)
    runs = found.select("row_key", "size", "at", F.collect_list("h").over(following).alias("run"), F.collect_list("at").over(following).alias("places"))
    many = F.size("shingles")
    placed = found.join(prefix, ["h", "size"]).select(
        "row_key", "size", (F.col("at") - F.col("offset")).alias("at"), "length", "shingles", "items"
    ).filter("at >= 0")
    return placed.join(runs, ["row_key", "size", "at"]).filter(
        (F.size("run") >= many)
        & (F.element_at("places", many) == F.col("at") + many - 1)
        & (F.slice("run", F.lit(1), many) == F.col("shingles"))
    ).select("row_key", F.col("at").alias("start"), "length", "items")


def contamination(docs: DataFrame, items: DataFrame, identity: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    Words are those of ``ITEM_WORD`` after lower-casing A-Z.  Every run of 10
    item words is a window; an item of fewer words is one window, an item or
    document without words has none.  A document word is hit when any
    occurrence of a window covers it.  A null text has no words; an empty
    item table hits nothing.  Equal rows get equal results; null ids stay.
    Repeated items count once by id.  Other columns are ignored.
    """
    places = occurrences(docs, items, identity=identity, text=text, **options)
    end = F.col("start") + F.col("length")
    earlier = Window.partitionBy("row_key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = places.select("row_key", "start", end.alias("end"), "length").distinct()
    hit = spans.withColumn("_reach", F.max("end").over(earlier)).groupBy("row_key").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("_reach", F.col("start"))))).alias("n_hit")
    )
    named = places.select("row_key", F.explode("items").alias("item")).distinct().groupBy("row_key").agg(
        F.sort_array(F.collect_list("item")).alias("_items")
    )
    sized = docs.select(F.col(identity).alias("doc_id"), F.size(item_words(F.col(text))).cast("long").alias("n_words"), row_key(identity, text).alias("row_key"))
    none = F.array().cast("array<string>")
    return sized.join(hit.join(named, "row_key"), "row_key", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("_items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("_items", none), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, identity: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark window touches."""
    hit = occurrences(docs, items, identity=identity, text=text, **options).select(F.col("row_key").alias("_row")).distinct()
    return docs.withColumn("_row", row_key(identity, text)).join(hit, "_row", "left_anti").select(*docs.columns)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ITEM_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ITEM_WORD}') AS w FROM benchmark),
cut AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos, w FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS win FROM cut),
places AS (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
found AS (SELECT doc_id, pos, n, item_id FROM places JOIN wins USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""
