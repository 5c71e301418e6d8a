"""Chart-data queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabaudit.operators import chartdata, hypothesis
from tabaudit.queries.common import GAPS, MEASURES, TEXT, lineitem_gaps, rnd, rounded, table, union

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# --- crosstabs and bars
QUERIES["crosstab"] = lambda s, d: hypothesis.crosstab(table(s, d, "orders"), ["o_orderpriority"], "o_orderstatus")
ORACLE["crosstab"] = """SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, o_orderstatus AS "class", count(*) AS n
FROM orders GROUP BY 2, 3"""

QUERIES["count_by_class"] = lambda s, d: chartdata.count_by_class(lineitem_gaps(s, d), ["l_returnflag"], "l_linestatus")
ORACLE["count_by_class"] = f"""SELECT 'l_returnflag' AS "column", l_returnflag AS value, l_linestatus AS "class", count(*) AS n
FROM {GAPS} WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 2, 3"""

QUERIES["crosstab_wide"] = lambda s, d: chartdata.crosstab_wide(table(s, d, "orders"), "o_orderpriority", "o_orderstatus")
ORACLE["crosstab_wide"] = """SELECT o_orderpriority AS value, count(*) FILTER (o_orderstatus = 'F') AS "F",
  count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""


# --- histograms
def _histogram_sql(source: str, cols: list[str], bins: int, target: str | None) -> str:
    cls = f"coalesce({target}, 'nan')" if target else "'all'"
    return union(
        f"""SELECT '{c}' AS "column", "class", bin, {rnd("min(lo) + bin * (min(hi) - min(lo)) / " + str(float(bins)), 6)} AS low,
  {rnd("min(lo) + (bin + 1) * (min(hi) - min(lo)) / " + str(float(bins)), 6)} AS high, count(*) AS n,
  {rnd(f"count(*) / (min(total) * (min(hi) - min(lo)) / {float(bins)})", 8)} AS density
FROM (SELECT "class", lo, hi, total, CAST(least({bins - 1}, greatest(0, floor((x - lo) / (hi - lo) * {float(bins)}))) AS INT) AS bin
  FROM (SELECT {cls} AS "class", CAST({c} AS DOUBLE) AS x FROM {source}) AS v,
    (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS total FROM {source}) AS r
  WHERE x IS NOT NULL) AS b GROUP BY "class", bin"""
        for c in cols
    )


def _hist(df):
    return df.select(
        "column", "class", "bin", "n", (F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"),
        (F.round("density", 8) + 0.0).alias("density"))


QUERIES["histogram_by_class"] = lambda s, d: _hist(
    chartdata.histogram(lineitem_gaps(s, d), ["l_quantity", "l_extendedprice"], 20, "l_returnflag"))
ORACLE["histogram_by_class"] = _histogram_sql(GAPS, ["l_quantity", "l_extendedprice"], 20, "l_returnflag")

QUERIES["histogram_density"] = lambda s, d: _hist(chartdata.histogram(table(s, d, "customer"), ["c_acctbal"], 30))
ORACLE["histogram_density"] = _histogram_sql("customer", ["c_acctbal"], 30, None)

QUERIES["histogram_fine"] = lambda s, d: _hist(chartdata.histogram(table(s, d, "orders"), ["o_totalprice"], 80))
ORACLE["histogram_fine"] = _histogram_sql("orders", ["o_totalprice"], 80, None)


# --- quartiles and boxes
def _violin_sql(source: str, cols: list[str], target: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", "class", count(x) AS n, {rnd("quantile_cont(x, 0.25)")} AS q25, {rnd("median(x)")} AS median,
  {rnd("quantile_cont(x, 0.75)")} AS q75
FROM (SELECT coalesce({target}, 'nan') AS "class", CAST({c} AS DOUBLE) AS x FROM {source}) AS v WHERE x IS NOT NULL GROUP BY "class" """
        for c in cols
    )


QUERIES["violin_quartiles"] = lambda s, d: rounded(chartdata.violin_stats(lineitem_gaps(s, d), MEASURES, "l_returnflag"))
ORACLE["violin_quartiles"] = _violin_sql(GAPS, MEASURES, "l_returnflag")


def _box_sql(source: str, cols: list[str], target: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", "class", count(*) AS n, {rnd("min(q1)", 6)} AS q25, {rnd("min(q2)", 6)} AS median, {rnd("min(q3)", 6)} AS q75,
  {rnd("min(x) FILTER (x >= lo)", 6)} AS whisker_low, {rnd("max(x) FILTER (x <= hi)", 6)} AS whisker_high,
  count(*) FILTER (x < lo OR x > hi) AS outliers
FROM (SELECT v."class", x, q1, q2, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM (SELECT coalesce({target}, 'nan') AS "class", CAST({c} AS DOUBLE) AS x FROM {source}) AS v
  JOIN (SELECT coalesce({target}, 'nan') AS "class", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, median(CAST({c} AS DOUBLE)) AS q2,
    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source} GROUP BY 1) AS q ON v."class" = q."class" WHERE x IS NOT NULL) AS f
GROUP BY "class" """
        for c in cols
    )


_EV = "(SELECT *, value * value AS tail FROM events) AS ev"
QUERIES["box_stats"] = lambda s, d: rounded(chartdata.box_stats(
    table(s, d, "events").withColumn("tail", F.col("value") * F.col("value")), ["value", "tail"], "event_type"), 6)
ORACLE["box_stats"] = _box_sql(_EV, ["value", "tail"], "event_type")

QUERIES["box_stats_distributed"] = lambda s, d: rounded(chartdata.box_stats(
    table(s, d, "lineitem"), MEASURES, "l_returnflag", method="distributed"), 6)
ORACLE["box_stats_distributed"] = _box_sql("lineitem", MEASURES, "l_returnflag")


# --- pairwise bins
def _pair_sql(source: str, cols: list[str], target: str, bins: int) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*cols, target])
    full = f"(SELECT * FROM {source} WHERE {whole}) AS w"

    def b(c: str) -> str:
        lo, hi = f"(SELECT CAST(min({c}) AS DOUBLE) FROM {full})", f"(SELECT CAST(max({c}) AS DOUBLE) FROM {full})"
        return f"CAST(least({bins - 1}, greatest(0, floor(({c} - {lo}) / ({hi} - {lo}) * {float(bins)}))) AS INT)"

    return union(
        f"""SELECT '{x}' AS var1, '{y}' AS var2, {target} AS "class", {b(x)} AS bin1, {b(y)} AS bin2, count(*) AS n
FROM {full} GROUP BY ALL"""
        for i, x in enumerate(cols) for y in cols[i + 1:]
    )


QUERIES["pair_bins"] = lambda s, d: chartdata.pair_bins(lineitem_gaps(s, d), MEASURES, "l_linestatus", 10)
ORACLE["pair_bins"] = _pair_sql(GAPS, MEASURES, "l_linestatus", 10)


# --- density curves: bins of the value range carry their mean and weight
def _density_sql(source: str, c: str, target: str | None, points: int, bins: int, extend: float) -> str:
    cls = f"coalesce({target}, 'nan')" if target else "'all'"
    return f"""WITH v AS (SELECT {cls} AS "class", CAST({c} AS DOUBLE) AS x FROM {source} WHERE {c} IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT "class", least({bins - 1}, floor((x - lo) / (hi - lo) * {float(bins)})) AS bin, count(*) AS w, avg(x) AS m FROM v, r GROUP BY 1, 2),
h AS (SELECT "class", count(*) AS n, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h FROM v GROUP BY 1),
g AS (SELECT point, lo - {extend} * (hi - lo) + point * ((hi - lo) * {1 + 2 * extend} / {points - 1}) AS x FROM r, (SELECT unnest(range(0, {points})) AS point) AS p)
SELECT '{c}' AS "column", h."class", CAST(point AS INT) AS point, {rnd("g.x")} AS x,
  {rnd("sum(w * exp(-0.5 * pow((g.x - m) / h, 2))) / (min(n) * min(h) * 2.5066282746310002)", 10)} AS density
FROM g, b JOIN h ON b."class" = h."class" GROUP BY h."class", point, g.x"""


def _curve(df):
    return df.select("column", "class", "point", (F.round("x", 4) + 0.0).alias("x"), (F.round("density", 10) + 0.0).alias("density"))


QUERIES["density_curve"] = lambda s, d: _curve(chartdata.density_curve(table(s, d, "customer"), ["c_acctbal"], points=200))
ORACLE["density_curve"] = _density_sql("customer", "c_acctbal", None, 200, 1024, 0.5)

QUERIES["violin_curves"] = lambda s, d: _curve(
    chartdata.violin_curves(table(s, d, "lineitem"), ["l_extendedprice"], "l_returnflag", points=60))
ORACLE["violin_curves"] = _density_sql("lineitem", "l_extendedprice", "l_returnflag", 60, 1024, 0.1)
