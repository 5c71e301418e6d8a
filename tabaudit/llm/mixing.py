"""Mix sources to target weights by exact budgets of words.

Every document gets a hash-random key.  Rows are range-sorted by (source, key),
each range is summed on its own, and the totals of the ranges give every range
its offset, so no task sees a whole source.  A source whose budget exceeds its
size is repeated for whole epochs; the last, partial epoch is cut where the
running total reaches the budget, inside a document if need be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.llm.common import WORD, broadcast_if_small, row_key, word_list
from tabaudit.operators.scale import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    """Number of words; each becomes one letter, as a list of them would take many times the text's memory."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(marked, " \t\n\v\f\r", "")).cast("long")


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """One row per source: its place in code point order (null last), size and target.

    ``share`` of all words is dealt by weight.  No target exceeds ``most``
    times its source's size: in the order of size per weight, sources are
    full as long as the level left by the full ones before them covers them,
    and the rest share the remaining words by weight.
    """
    every = Window.partitionBy(F.lit(1))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_ratio = every.orderBy("_ratio", "place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    totals = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(cycle, (F.col("place") - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    full = totals.withColumn("_full", F.col("_ratio") <= level)
    rest = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    left = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(every)
    return full.select(
        "source", "place", "source_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * (rest / left)).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    identity: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 0,
) -> DataFrame:
    """Words taken from every row: (doc_id, source, size, source_size, target, epochs,
    row_key, taken).

    ``taken`` is ``epochs`` times the size plus the words of the partial
    epoch.  A null or empty text has size 0 and is never taken.  A null source
    is a source of its own, last in order.  Rows are ordered by the hash of
    their id, then id and size; equal rows are interchangeable.  Null ids are
    ordered first.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            F.col(identity).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            row_key(identity, text).alias("row_key"),
        ),
        "sizes",
    )
    targets = source_targets(sized, weights, share, most).withColumnRenamed("source", "_source")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "_key", F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("doc_id").cast("string")))
    )
    order = ["_key", "doc_id", "size"]
    placed = materialize(
        keyed.repartitionByRange(ranges, "place", *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    earlier = Window.partitionBy("place").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("place", "_range").agg(F.sum("size").alias("_words"))
        .select("place", "_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("place", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    part = F.least(F.greatest(F.col("_left") - F.col("_before"), F.lit(0)), F.col("size"))
    return (
        placed.join(offsets, ["place", "_range"])
        .withColumn("_before", before)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("_left", budget - F.col("epochs") * F.col("source_size"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "epochs", "row_key",
            (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        )
    )


def _source_key(key: Column, source: Column) -> Column:
    """Tells equal rows of different sources apart."""
    return F.xxhash64(key, F.lit(3), source)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_place``, 1, 2, ... among those of one ``_row``, counted per partition first."""
    dealt = materialize(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "equal_rows")
    earlier = Window.partitionBy("_row").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_row", "_part").agg(F.count("*").alias("_rows")).select(
        "_row", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_row", "_part").orderBy("_at")
    return (
        dealt.join(offsets, ["_row", "_part"]).withColumn("_place", F.col("_offset") + F.row_number().over(inside))
        .drop("_part", "_at", "_offset")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every taken document once per epoch, with ``epoch`` and ``words_taken``.

    Copies of whole epochs keep their text; where a budget ends inside a
    document, its text is cut to the first words, joined by one blank.
    Columns of ``docs`` are kept.  Of rows equal in id, text and source as
    many are taken, and as far, as ``mix`` says; which of them is open.
    """
    identity, text, source = (options.get(x, d) for x, d in (("identity", "doc_id"), ("text", "text"), ("source", "source")))
    keyed = docs.withColumn("_row", _source_key(row_key(identity, text), F.col(source)))
    # At most one row of a source is cut: of equal rows some take an epoch more than the others, one a part of it.
    base = F.first(F.col("epochs") * F.col("size"))
    takes = materialize(
        mix(docs, **options).groupBy(_source_key(F.col("row_key"), F.col("source")).alias("_row"))
        .agg(F.first("size").alias("_size"), base.alias("_base"), F.sum("taken").alias("_taken"), F.count("*").alias("_n"))
        .filter("_taken > 0").withColumn("_extra", F.col("_taken") - F.col("_n") * F.col("_base")).drop("_taken"), "takes",
    )
    # Only rows among which a budget ends are numbered.
    uneven = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_n") * F.col("_size")) & (F.col("_n") > 1)
    rows = keyed.join(takes.filter(~uneven), "_row").withColumn("_place", F.lit(1).cast("long"))
    split = takes.filter(uneven)
    if not split.isEmpty():
        rows = rows.unionByName(_numbered(keyed.join(broadcast_if_small(split), "_row")))
    taken = F.col("_base") + F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_extra") - (F.col("_place") - 1) * F.col("_size")))
    copies = F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("epoch") - 1) * F.col("_size"))
    cut = F.array_join(F.slice(word_list(F.col(text)), F.lit(1), F.col("words_taken").cast("int")), " ")
    return (
        rows.withColumn("_taken", taken).filter("_taken > 0")
        .select(*docs.columns, "_taken", "_size", F.explode(copies).alias("epoch"))
        .withColumn("words_taken", words)
        .withColumn(text, F.when(F.col("words_taken") < F.col("_size"), cut).otherwise(F.col(text)))
        .select(*docs.columns, "epoch", "words_taken")
    )


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM totals),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM placed),
levels AS (
  SELECT *, cap / w <= (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    w * ((budget - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) / sum(w) FILTER (WHERE NOT is_full) OVER ()) END AS target
  FROM levels),
cuts AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(s.size) OVER (PARTITION BY t.source ORDER BY md5(concat_ws('#', '0', s.doc_id::VARCHAR)), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(greatest(floor(target)::BIGINT - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM cuts"""
