"""Profile queries and their SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.operators import frequent, profiling, scale, states
from tabaudit.plans.profile import metadata, profile
from tabaudit.queries.common import (
    COLUMNS, GAPS, MEASURES, NUMERIC, TEXT, lineitem_gaps, rnd, rounded, table, union,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


# --- shape, nulls, duplicates
QUERIES["shape_profile"] = lambda s, d: profiling.shape(table(s, d, "orders"))
ORACLE["shape_profile"] = "SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns FROM orders"

QUERIES["null_profile"] = lambda s, d: rounded(profiling.null_counts(lineitem_gaps(s, d)))
ORACLE["null_profile"] = union(
    f"""SELECT '{c}' AS "column", count(*) AS total, count(*) - count({c}) AS nulls,
  {rnd(f"(count(*) - count({c})) * 100.0 / count(*)")} AS null_pct FROM {GAPS}"""
    for c in COLUMNS["lineitem"]
)

_CELLS = " + ".join(f"(count(*) - count({c}))" for c in COLUMNS["lineitem"])
QUERIES["null_totals"] = lambda s, d: rounded(profiling.null_totals(lineitem_gaps(s, d)))
ORACLE["null_totals"] = f"""SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns,
  CAST({_CELLS} AS BIGINT) AS null_cells, {rnd(f"({_CELLS}) * 100.0 / (count(*) * 11)")} AS null_percentage FROM {GAPS}"""

QUERIES["duplicate_rows"] = lambda s, d: profiling.duplicate_rows(
    table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
)
ORACLE["duplicate_rows"] = """SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows,
  CAST(sum(n) AS BIGINT) - count(*) AS duplicate_rows
FROM (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) AS g"""

QUERIES["duplicate_rows_hashed"] = lambda s, d: profiling.duplicate_rows(
    table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), method="hashed"
)
ORACLE["duplicate_rows_hashed"] = ORACLE["duplicate_rows"]

QUERIES["table_overview"] = lambda s, d: rounded(profiling.overview(lineitem_gaps(s, d)))
ORACLE["table_overview"] = f"""SELECT t.*, dup.duplicate_rows FROM ({ORACLE["null_totals"]}) AS t,
 (SELECT CAST(sum(n) AS BIGINT) - count(*) AS duplicate_rows FROM (SELECT {", ".join(COLUMNS["lineitem"])}, count(*) AS n FROM {GAPS} GROUP BY ALL) AS g) AS dup"""


# --- moments and quartiles
def _describe_sql(source: str, cols: list[str], quartiles: bool = True) -> str:
    def one(c: str) -> str:
        mean = f"avg({c}) OVER ()"
        q = ""
        if quartiles:
            q = f"""{rnd("median(x)")} AS median, {rnd("quantile_cont(x, 0.25)")} AS q25, {rnd("quantile_cont(x, 0.75)")} AS q75,"""
        return f"""SELECT '{c}' AS "column", count(x) AS n, {rnd("avg(x)")} AS mean, {q} {rnd("stddev_samp(x)")} AS std,
  {rnd("min(x)")} AS min, {rnd("max(x)")} AS max,
  {rnd("avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5)")} AS skewness,
  {rnd("avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3")} AS kurtosis, count(*) - count(x) AS null_count
FROM (SELECT CAST({c} AS DOUBLE) AS x, {mean} AS m FROM {source}) AS v"""

    return union(one(c) for c in cols)


QUERIES["numeric_describe"] = lambda s, d: rounded(profiling.describe(lineitem_gaps(s, d), NUMERIC["lineitem"]))
ORACLE["numeric_describe"] = _describe_sql(GAPS, NUMERIC["lineitem"])

QUERIES["numeric_describe_distributed"] = lambda s, d: rounded(
    profiling.describe(table(s, d, "orders"), NUMERIC["orders"], method="distributed")
)
ORACLE["numeric_describe_distributed"] = _describe_sql("orders", NUMERIC["orders"])

# --- states of files, merged
# Six files, or as many as hold so many bytes of the table each.
_FILE_BYTES = 32 * 1024 * 1024


def _lineitem_files(s, d):
    path = scale.scratch_path(s, "files")
    n = max(6, math.ceil(scale.plan_bytes(table(s, d, "lineitem")) / _FILE_BYTES))
    lineitem_gaps(s, d).repartition(n, "l_suppkey", "l_orderkey").write.parquet(path)
    return path


def _states(s, path):
    return states.merged_states(states.file_states(s, path, scale.scratch_path(s, "store")))


def _described_files(s, d):
    path = _lineitem_files(s, d)
    return rounded(states.described(s.read.parquet(path), NUMERIC["lineitem"], scale.materialize(_states(s, path), "states")))


QUERIES["file_states_describe"] = _described_files
ORACLE["file_states_describe"] = _describe_sql(GAPS, NUMERIC["lineitem"])

QUERIES["file_states_sizes"] = lambda s, d: states.merged_states(
    states.file_states(s, _lineitem_files(s, d), scale.scratch_path(s, "store"))
).select("column", "rows", "present", "n", (F.round("mean", 4) + F.lit(0.0)).alias("mean"))
ORACLE["file_states_sizes"] = union(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count({c}) AS present, {f"count({c})" if c in NUMERIC["lineitem"] else "CAST(0 AS BIGINT)"} AS n,
  {rnd(f"avg({c})") if c in NUMERIC["lineitem"] else "CAST(NULL AS DOUBLE)"} AS mean FROM {GAPS}""" for c in COLUMNS["lineitem"])

QUERIES["column_moments"] = lambda s, d: rounded(profiling.moments(table(s, d, "events"), NUMERIC["events"]))
ORACLE["column_moments"] = _describe_sql("events", NUMERIC["events"], quartiles=False)


def _quantiles(q, names):
    return rounded(q.select(
        *[c for c in q.columns if c not in ("q",)], *[F.col("q")[i].alias(n) for i, n in enumerate(names)]
    ))


_PROBS = [0.01, 0.1, 0.5, 0.9, 0.99]
_PNAMES = ["p01", "p10", "p50", "p90", "p99"]


def _quantile_sql(source: str, cols: list[str], by: str) -> str:
    picks = ", ".join(f"{rnd(f'quantile_cont(x, {p})')} AS {n}" for p, n in zip(_PROBS, _PNAMES))
    return union(
        f"""SELECT {by}, '{c}' AS "column", count(x) AS n, {picks} FROM (SELECT {by}, CAST({c} AS DOUBLE) AS x FROM {source}) AS v GROUP BY {by}"""
        for c in cols
    )


QUERIES["exact_quantiles_by_class"] = lambda s, d: _quantiles(
    scale.exact_quantiles(table(s, d, "lineitem"), MEASURES, _PROBS, by=["l_returnflag"], method="distributed"), _PNAMES
)
ORACLE["exact_quantiles_by_class"] = _quantile_sql("lineitem", MEASURES, "l_returnflag")

QUERIES["running_totals"] = lambda s, d: rounded(scale.running_totals(
    table(s, d, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n")),
    "l_extendedprice", ["n"], ["l_returnflag"], small=False,
))
ORACLE["running_totals"] = f"""SELECT l_returnflag, {rnd("l_extendedprice")} AS l_extendedprice, n,
  CAST(coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before,
  CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS n_total
FROM (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL) AS g"""


# --- distinct values and categories
QUERIES["distinct_counts"] = lambda s, d: profiling.distinct_counts(table(s, d, "orders"))
ORACLE["distinct_counts"] = union(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_count FROM orders""" for c in COLUMNS["orders"]
)

QUERIES["value_counts"] = lambda s, d: profiling.value_counts(lineitem_gaps(s, d), TEXT["lineitem"])
ORACLE["value_counts"] = union(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM {GAPS} GROUP BY {c}""" for c in TEXT["lineitem"]
)


def _categories_sql(source: str, cols: list[str]) -> str:
    return union(
        f"""SELECT '{c}' AS "column", count(v) AS unique_values, arg_min(v, (-n, v)) FILTER (v IS NOT NULL) AS most_common,
  coalesce(max(n) FILTER (v IS NOT NULL), 0) AS most_common_count,
  CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_count
FROM (SELECT {c} AS v, count(*) AS n FROM {source} GROUP BY {c}) AS g"""
        for c in cols
    )


def _top_sql(source: str, cols: list[str], k: int) -> str:
    return union(f"""SELECT * FROM (SELECT '{c}' AS "column", v AS value, n, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS place FROM (
  SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) AS g) AS p WHERE place <= {k}""" for c in cols)


# Frequent values, all-different texts, and documents with exact copies; eight counters a task make the summaries work.
_TOPS = (("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"], 3, 8), ("documents", ["text", "lang", "source", "doc_id"], 4, 4096))
QUERIES["top_values"] = lambda s, d: reduce(DataFrame.unionByName, [
    frequent.top_values(table(s, d, t), cols, k, kept) for t, cols, k, kept in _TOPS])
ORACLE["top_values"] = union(_top_sql(t, cols, k) for t, cols, k, _ in _TOPS)

QUERIES["categorical_profile_digested"] = lambda s, d: profiling.categorical_profile(
    lineitem_gaps(s, d), TEXT["lineitem"], "digested").unionByName(profiling.categorical_profile(table(s, d, "documents"), TEXT["documents"], "digested"))
ORACLE["categorical_profile_digested"] = union([_categories_sql(GAPS, TEXT["lineitem"]), _categories_sql("documents", TEXT["documents"])])

QUERIES["categorical_profile"] = lambda s, d: profiling.categorical_profile(lineitem_gaps(s, d)).unionByName(
    profiling.categorical_profile(table(s, d, "part"))
)
ORACLE["categorical_profile"] = union([_categories_sql(GAPS, TEXT["lineitem"]), _categories_sql("part", TEXT["part"])])


# --- correlation
def _pairs_sql(source: str, cols: list[str]) -> str:
    return union(
        f"""SELECT '{a}' AS var1, '{b}' AS var2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {rnd(f"corr({a}, {b})")} AS r FROM {source}"""
        for i, a in enumerate(cols) for b in cols[i + 1:]
    )


QUERIES["corr_pairs"] = lambda s, d: rounded(profiling.correlation_pairs(lineitem_gaps(s, d), NUMERIC["lineitem"]))
ORACLE["corr_pairs"] = _pairs_sql(GAPS, NUMERIC["lineitem"])

QUERIES["corr_matrix"] = lambda s, d: rounded(profiling.correlation_matrix(table(s, d, "orders"), NUMERIC["orders"]))
ORACLE["corr_matrix"] = union(
    [f"SELECT var1, var2, n, r FROM ({_pairs_sql('orders', NUMERIC['orders'])}) AS a",
     f"SELECT var2 AS var1, var1 AS var2, n, r FROM ({_pairs_sql('orders', NUMERIC['orders'])}) AS b"]
    + [f"SELECT '{c}' AS var1, '{c}' AS var2, count({c}) AS n, 1.0::DOUBLE AS r FROM orders" for c in NUMERIC["orders"]]
)

# Fourteen columns: the wide path with per-partition matrices.
_DERIVED = {
    "net": "l_extendedprice * (1 - l_discount)",
    "gross": "l_extendedprice * (1 + l_tax)",
    "unit": "l_extendedprice / l_quantity",
    "cut": "l_extendedprice * l_discount",
    "duty": "l_extendedprice * l_tax",
    "root": "sqrt(l_extendedprice)",
}
_WIDE = NUMERIC["lineitem"] + list(_DERIVED)
_WIDE_SQL = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in _DERIVED.items())} FROM {GAPS}) AS wide"


def _wide(s, d):
    return lineitem_gaps(s, d).withColumns({k: F.expr(v) for k, v in _DERIVED.items()})


QUERIES["corr_wide"] = lambda s, d: rounded(profiling.correlation_pairs(_wide(s, d), _WIDE))
ORACLE["corr_wide"] = _pairs_sql(_WIDE_SQL, _WIDE)

QUERIES["high_corr_pairs"] = lambda s, d: rounded(profiling.high_correlations(_wide(s, d), _WIDE))
ORACLE["high_corr_pairs"] = f"""SELECT var1, var2, r AS correlation FROM ({_pairs_sql(_WIDE_SQL, _WIDE)}) AS p WHERE abs(r) > 0.7"""


# --- outliers
def outlier_sql(source: str, cols: list[str]) -> str:
    return union(
        f"""SELECT '{c}' AS "column", {rnd("min(lo)", 6)} AS low, {rnd("min(hi)", 6)} AS high,
  count(*) FILTER (x < lo OR x > hi) AS outliers, {rnd("count(*) FILTER (x < lo OR x > hi) * 100.0 / count(*)", 6)} AS outlier_pct
FROM (SELECT x, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
  (SELECT CAST({c} AS DOUBLE) AS x FROM {source}) AS v,
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}) AS q) AS f"""
        for c in cols
    )


# events.value squared has a long upper tail.
_EV = "(SELECT *, value * value AS tail FROM events) AS ev"
QUERIES["iqr_outliers"] = lambda s, d: rounded(
    profiling.iqr_outliers(table(s, d, "events").withColumn("tail", F.col("value") * F.col("value")), ["user_id", "value", "tail"]), 6
)
ORACLE["iqr_outliers"] = outlier_sql(_EV, ["user_id", "value", "tail"])

QUERIES["iqr_outliers_distributed"] = lambda s, d: rounded(
    profiling.iqr_outliers(lineitem_gaps(s, d), MEASURES, method="distributed"), 6
)
ORACLE["iqr_outliers_distributed"] = outlier_sql(GAPS, MEASURES)


# --- the whole profile as one nested metadata row, read back field by field
def _metadata(s, d):
    df = table(s, d, "customer")
    row = metadata(profile(df, curves=False), "customer")
    return rounded(row.select("dataset", "overview.*", F.size("statistics").alias("described"),
                              F.size("categories").alias("categories"), F.size("high_correlation").alias("correlated")))


QUERIES["profile_metadata"] = _metadata
ORACLE["profile_metadata"] = """SELECT 'customer' AS dataset, count(*) AS total_rows, CAST(5 AS BIGINT) AS total_columns,
  CAST(0 AS BIGINT) AS null_cells, CAST(0 AS DOUBLE) AS null_percentage,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer) AS u) AS duplicate_rows,
  3 AS described, 2 AS categories,
  CAST((abs(corr(c_custkey, c_nationkey)) > 0.7)::INT + (abs(corr(c_custkey, c_acctbal)) > 0.7)::INT + (abs(corr(c_nationkey, c_acctbal)) > 0.7)::INT AS INT) AS correlated
FROM customer"""
