"""Result tables, metadata, audit log and run manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.functions.columns import log_line

LOG_SCHEMA = "ts timestamp, file string, status string, reason string"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_tables(tables: Mapping[str, DataFrame], root: str, mode: str = "errorifexists") -> None:
    """One folder per table."""
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", mode)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def write_metadata(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def log_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(ts, file, status, reason); status is SUCCESS, FAILED, SKIPPED or ERROR."""
    df = spark.createDataFrame(rows, "file string, status string, reason string")
    return df.select(F.current_timestamp().alias("ts"), "file", "status", "reason")


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def commit_log(log: DataFrame, path: str, run: str) -> None:
    """Write the rows of one run; a repeated run replaces its own rows and no others.

    The run is a partition of the log folder and is overwritten as a whole,
    so a batch that failed and starts again leaves one set of rows.  A run
    without rows writes nothing.
    """
    rows = log.select("ts", "file", "status", "reason", F.lit(run).alias("run"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """(ts, file, status, reason, run) of all committed runs, or of one."""
    log = spark.read.schema(f"{LOG_SCHEMA}, run string").parquet(path)
    return log if run is None else log.where(F.col("run") == F.lit(run))


def log_lines(log: DataFrame) -> DataFrame:
    return log.select(log_line(F.col("ts"), F.col("file"), F.col("status"), F.col("reason")).alias("line"))


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def manifest(log: DataFrame) -> DataFrame:
    """One row: inputs, successes, failures, overall status."""
    ok = F.count_if(F.col("status") == "SUCCESS")
    bad = F.count_if(F.col("status") != "SUCCESS")
    return log.agg(F.count(F.lit(1)).alias("inputs"), ok.alias("succeeded"), bad.alias("failed")).withColumn(
        "status", F.when(F.col("failed") == 0, "completed").otherwise("completed_with_errors")
    )


def report_text(report: DataFrame) -> DataFrame:
    """The one-row audit report as text lines."""
    def line(i: int, label: str, value: Column):
        return F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(label), value).alias("line"))

    return report.select(F.inline(F.array(
        line(1, "# AUDIT: ", F.col("dataset")),
        line(2, "Target: ", F.coalesce("target", F.lit("none"))),
        line(3, "AUC: ", F.coalesce(F.format_string("%.3f", "auc"), F.lit("n/a"))),
        line(4, "Rows taken out as outliers: ", F.coalesce("rows_removed", F.lit(0)).cast("string")),
        line(5, "- ", F.coalesce("normality", F.lit(""))),
    )))


def stats_lines(tests: DataFrame, kind: str) -> DataFrame:
    """Fixed-width lines: column, test, p, stars."""
    return tests.select(
        F.concat(
            F.rpad(F.substring("column", 1, 28), 30, " "), F.lit(" "), F.rpad(F.lit(kind), 10, " "), F.lit(" "),
            F.format_string("%.4f", "p_value"), F.lit("     "), F.col("significance"),
        ).alias("line")
    )


def summary_lines(stats: DataFrame) -> DataFrame:
    """Text block per described column."""
    return stats.select("column", F.format_string(
        "%s:\n  Mean: %.4f\n  Median: %.4f\n  Std Dev: %.4f\n  Range: [%.4f, %.4f]\n  Skewness: %.4f\n  Kurtosis: %.4f",
        "column", "mean", "median", "std", "min", "max", "skewness", "kurtosis",
    ).alias("text"))
