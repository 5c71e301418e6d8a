"""Missing-rate roll-up over many tables and the bias-risk score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import clamp
from tabaudit.operators.profiling import null_totals


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, cols, missing, cells): one full pass per table."""
    out = None
    for name, df in tables.items():
        part = null_totals(df).select(
            F.lit(name).alias("table"), F.col("total_rows").alias("rows"), F.col("total_columns").alias("cols"),
            F.col("null_cells").alias("missing"), (F.col("total_rows") * F.col("total_columns")).alias("cells"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def rollup(sizes: DataFrame) -> DataFrame:
    """One row: files, rows, mean columns (whole), missing rate, bias risk."""
    total = sizes.agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("rows").alias("rows"),
        F.floor(F.avg("cols")).cast("bigint").alias("cols"), F.sum("missing").alias("missing"), F.sum("cells").alias("cells"),
    ).where("cells > 0")
    rate = F.col("missing") / F.col("cells")
    return total.select(
        "file_count", "rows", "cols", rate.alias("missing_rate"), bias_score(rate, F.col("cols")).alias("potential_bias")
    )


def bias_score(missing_rate, cols):
    return clamp(missing_rate * 100 + cols * F.lit(0.2), 5.0, 45.0)
