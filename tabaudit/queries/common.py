"""Helpers for the registered queries: inputs, rounding, SQL snippets.

Each query module pairs a Spark query with the SQL that must give the same
rows.  Doubles are rounded on both sides because engines add in other orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round DOUBLE columns; adding zero turns -0.0 into 0.0."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def rnd(sql: str, digits: int = 4) -> str:
    return f"(round(CAST({sql} AS DOUBLE), {digits}) + 0.0)"


def union(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# lineitem with natural gaps: zero discount, zero tax, quantity one and flag N
# count as "not recorded".
def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_quantity": F.nullif("l_quantity", F.lit(1.0)),
            "l_discount": F.nullif("l_discount", F.lit(0.0)),
            "l_tax": F.nullif("l_tax", F.lit(0.0)),
            "l_returnflag": F.nullif("l_returnflag", F.lit("N")),
        }
    )


GAPS = """(SELECT * REPLACE (nullif(l_quantity, 1.0) AS l_quantity, nullif(l_discount, 0.0) AS l_discount,
  nullif(l_tax, 0.0) AS l_tax, nullif(l_returnflag, 'N') AS l_returnflag) FROM lineitem) AS gaps"""

# Columns of the driver tables, in file order.
COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
}
NUMERIC = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"],
    "labels": ["doc_id", "quality", "toxic"],
}
TEXT = {
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
