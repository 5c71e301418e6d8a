"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.operators.scale import materialize


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of a written edge table."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; root is the smallest node reachable.

    ``edges`` has two columns of one type.  Loops and repeated edges change
    nothing; edges with a null end are ignored; no edges give no rows.  Every
    round is written to the shared folder; rounds grow with the logarithm of
    the largest component.
    """
    a, b = edges.columns
    current = materialize(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct(), "edges"
    )
    mark = _mark(current)
    while True:
        both = current.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(
            current.select(F.col("root").alias("u"), F.col("node").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("node"), F.col("m").alias("root"))
        current = materialize(small.unionByName(least.select(F.col("u").alias("node"), F.col("m").alias("root"))).distinct(), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            return current
