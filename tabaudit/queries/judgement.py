"""Quality findings, hypothesis tests and leakage queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabaudit.config import QualityRules
from tabaudit.functions.special import normal_quantile_sql
from tabaudit.operators import evidence, hypothesis, leakage, quality
from tabaudit.plans.critique import critique
from tabaudit.queries.common import (
    COLUMNS, GAPS, MEASURES, NUMERIC, TEXT, lineitem_gaps, rnd, rounded, table, union,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


# --- quality findings -------------------------------------------------------
# A lineitem copy with defects: gaps, a column that repeats the quantity (the
# "target"), and a near copy of it.
_DEFECTS = f"""(SELECT *, l_quantity AS target, l_quantity + l_tax AS near_copy, nullif(l_linestatus, 'F') AS half_empty,
  CASE WHEN l_linenumber = 1 THEN l_shipdate END AS mostly_empty FROM {GAPS}) AS defects"""


def _defects(s, d):
    return lineitem_gaps(s, d).withColumns({
        "target": F.col("l_quantity"),
        "near_copy": F.col("l_quantity") + F.col("l_tax"),
        "half_empty": F.nullif("l_linestatus", F.lit("F")),
        "mostly_empty": F.when(F.col("l_linenumber") == 1, F.col("l_shipdate")),
    })


_DEFECT_COLUMNS = COLUMNS["lineitem"] + ["target", "near_copy", "half_empty", "mostly_empty"]
_DEFECT_NUMERIC = NUMERIC["lineitem"] + ["target", "near_copy"]
_DEFECT_TEXT = TEXT["lineitem"] + ["half_empty"]


def _findings_sql(name: str, source: str, columns: list[str], numeric: list[str], text: list[str], target: str | None = None) -> str:
    def row(check, column, severity, metric, value, frm):
        return f"""SELECT '{name}' AS dataset, '{check}' AS "check", {column} AS "column", {severity} AS severity,
  '{metric}' AS metric, {rnd(value)} AS value FROM {frm}"""

    parts = [
        row("shape", "CAST(NULL AS VARCHAR)", "'warning'", "rows", "n", f"(SELECT count(*) AS n FROM {source}) AS q WHERE n < 50"),
        row("duplicates", "CAST(NULL AS VARCHAR)", "CASE WHEN p > 10 THEN 'issue' ELSE 'warning' END", "duplicate_pct", "p",
            f"(SELECT (sum(n) - count(*)) * 100.0 / sum(n) AS p FROM (SELECT {', '.join(columns)}, count(*) AS n FROM {source} GROUP BY ALL) AS g) AS q WHERE p > 0"),
    ]
    for c in columns:
        parts.append(row("missing", f"'{c}'", "CASE WHEN p > 50 THEN 'issue' ELSE 'warning' END", "null_pct", "p",
                         f"(SELECT (count(*) - count({c})) * 100.0 / count(*) AS p FROM {source}) AS q WHERE p > 20"))
    for c in numeric:
        parts.append(row("outliers", f"'{c}'", "CASE WHEN p > 10 THEN 'issue' ELSE 'warning' END", "outlier_pct", "p", f"""
  (SELECT count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) AS p FROM
    (SELECT CAST({c} AS DOUBLE) AS x FROM {source}) AS v,
    (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}) AS w) AS q WHERE p > 2"""))
    for c in text:
        parts.append(row("types", f"'{c}'", "'warning'", "distinct_count", "u",
                         f"(SELECT count(DISTINCT {c}) AS u, count(*) AS n FROM {source}) AS q WHERE u > n * 0.5"))
    for c in numeric if target else []:
        if c != target:
            parts.append(row("leakage", f"'{c}'", "CASE WHEN r > 0.99 THEN 'issue' ELSE 'warning' END", "abs_r", "r",
                             f"(SELECT abs(corr({c}, {target})) AS r FROM {source}) AS q WHERE r > 0.95"))
    return union(parts)


_CRITIQUED = ("customer", "part", "events", "region", "nation")


def _all_findings(s, d):
    tables = {"defects": _defects(s, d)}
    for name in _CRITIQUED:
        tables[name] = table(s, d, name)
    return critique(tables, QualityRules())


_NUM = {**NUMERIC, "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"]}
_TXT = {**TEXT, "region": ["r_name"], "nation": ["n_name"]}
_FINDINGS = union(
    [_findings_sql("defects", _DEFECTS, _DEFECT_COLUMNS, _DEFECT_NUMERIC, _DEFECT_TEXT, "target")]
    + [_findings_sql(t, t, COLUMNS[t], _NUM[t], _TXT[t]) for t in _CRITIQUED]
)
QUERIES["quality_findings"] = lambda s, d: rounded(_all_findings(s, d).drop("message"))
ORACLE["quality_findings"] = _FINDINGS

QUERIES["quality_summary"] = lambda s, d: quality.summary(_all_findings(s, d))
ORACLE["quality_summary"] = f"""SELECT dataset, count(*) FILTER (severity = 'issue') AS issues,
  count(*) FILTER (severity = 'warning') AS warnings FROM ({_FINDINGS}) AS f GROUP BY dataset"""

QUERIES["quality_report_lines"] = lambda s, d: quality.report_lines(
    quality.duplicate_findings(table(s, d, "orders").select("o_custkey", "o_orderstatus"), "orders")
    .unionByName(quality.missing_findings(lineitem_gaps(s, d), "lineitem"))
)
ORACLE["quality_report_lines"] = f"""SELECT 'orders' AS dataset, CASE WHEN p > 10 THEN 0 ELSE 1 END AS "rank",
  CASE WHEN p > 10 THEN 'ISSUE: ' ELSE 'WARNING: ' END || k || ' rows repeat another one (' || format('{{:.1f}}', p) || '%)' AS line
FROM (SELECT CAST(sum(n) - count(*) AS BIGINT) AS k, CAST((sum(n) - count(*)) * 100.0 / sum(n) AS DOUBLE) AS p
  FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) AS g) AS q WHERE k > 0
UNION ALL
SELECT 'lineitem', CASE WHEN p > 50 THEN 0 ELSE 1 END,
  CASE WHEN p > 50 THEN 'ISSUE: ' ELSE 'WARNING: ' END || 'l_returnflag: ' || CASE WHEN p > 50 THEN 'more than half empty, ' ELSE '' END || format('{{:.1f}}', p) || '% without a value'
FROM (SELECT CAST((count(*) - count(l_returnflag)) * 100.0 / count(*) AS DOUBLE) AS p FROM {GAPS}) AS q WHERE p > 20"""


# --- tests of two or more classes ------------------------------------------
def _t_sql(source: str, target: str, cols: list[str], a: str, b: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", n0, n1, m0 AS mean0, m1 AS mean1,
  (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) AS t, n0 + n1 - 2 AS dof
FROM (SELECT count({c}) FILTER ({target} = '{a}') AS n0, count({c}) FILTER ({target} = '{b}') AS n1,
  avg({c}) FILTER ({target} = '{a}') AS m0, avg({c}) FILTER ({target} = '{b}') AS m1,
  var_samp({c}) FILTER ({target} = '{a}') AS v0, var_samp({c}) FILTER ({target} = '{b}') AS v1 FROM {source}) AS q"""
        for c in cols
    )


_T_GAPS = _t_sql(GAPS, "l_linestatus", MEASURES, "F", "O")
QUERIES["ttest_two_class"] = lambda s, d: rounded(hypothesis.t_test(lineitem_gaps(s, d), "l_linestatus", MEASURES))
ORACLE["ttest_two_class"] = f"""SELECT "column", n0, n1, {rnd("mean0")} AS mean0, {rnd("mean1")} AS mean1, {rnd("t")} AS t, dof FROM ({_T_GAPS}) AS q"""

def t_even_sql(source: str, target: str, cols: list[str], a: str, b: str) -> str:
    """With the exact two-sided p for an even number of degrees of freedom: a
    finite series in cos^2 with coefficients gamma(k + 1/2) / (sqrt(pi) gamma(k + 1))."""
    return f"""SELECT "column", t, dof, 1 - (abs(t) / sqrt(dof + t * t)) * (
  SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1.0) - 0.5723649429247001 + k * ln(dof / (dof + t * t))))
  FROM (SELECT unnest(range(0, CAST(dof // 2 AS BIGINT))) AS k) AS ks) AS p FROM ({_t_sql(source, target, cols, a, b)}) AS t"""


_T_EVEN = ["l_quantity", "l_extendedprice"]
QUERIES["ttest_p_values"] = lambda s, d: rounded(
    hypothesis.with_t_pvalue(hypothesis.t_test(table(s, d, "lineitem"), "l_linestatus", _T_EVEN)).select(
        "column", "t", "p_value", "significance"), 6)
ORACLE["ttest_p_values"] = f"""SELECT "column", {rnd("t", 6)} AS t, {rnd("p", 6)} AS p_value,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance
FROM ({t_even_sql("lineitem", "l_linestatus", _T_EVEN, "F", "O")}) AS q"""


def _chi_sql(source: str, target: str, cols: list[str]) -> str:
    return union(
        f"""SELECT '{c}' AS "column", n, CASE WHEN dof = 0 THEN 0.0 ELSE chi END AS chi2, dof FROM (
 SELECT max(total) AS n, sum(pow(greatest(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 0), 2) / e) AS chi, max(dof) AS dof FROM (
  SELECT coalesce(x.o, 0) AS o, r.r * k.k * 1.0 / g.total AS e, g.total, g.dof FROM
   (SELECT {c} AS a, count(*) AS r FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL GROUP BY 1) AS r
   CROSS JOIN (SELECT {target} AS b, count(*) AS k FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL GROUP BY 1) AS k
   CROSS JOIN (SELECT count(*) AS total, (count(DISTINCT {c}) - 1) * (count(DISTINCT {target}) - 1) AS dof FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL) AS g
   LEFT JOIN (SELECT {c} AS a, {target} AS b, count(*) AS o FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL GROUP BY 1, 2) AS x
     ON x.a = r.a AND x.b = k.b) AS cells) AS q"""
        for c in cols
    )


QUERIES["chi2_independence"] = lambda s, d: rounded(
    hypothesis.chi_square(table(s, d, "orders"), "o_orderstatus", ["o_orderpriority", "o_orderdate"])
)
ORACLE["chi2_independence"] = f"""SELECT "column", n, {rnd("chi2")} AS chi2, dof FROM ({_chi_sql("orders", "o_orderstatus", ["o_orderpriority", "o_orderdate"])}) AS q"""

# Two by two: the continuity correction applies.
QUERIES["chi2_two_by_two"] = lambda s, d: rounded(
    hypothesis.chi_square(lineitem_gaps(s, d), "l_linestatus", ["l_returnflag"]), 6)
ORACLE["chi2_two_by_two"] = f"""SELECT "column", n, {rnd("chi2", 6)} AS chi2, dof FROM ({_chi_sql(GAPS, "l_linestatus", ["l_returnflag"])}) AS q"""

# Even degrees of freedom have a closed tail: exp(-y) * sum y^k / k!.
_EVEN_TAIL = "exp(-chi2 / 2) * (SELECT sum(pow(chi2 / 2, k) / gamma(k + 1.0)) FROM (SELECT unnest(range(0, CAST(dof // 2 AS BIGINT))) AS k) AS ks)"


def chi_even_sql(source: str, target: str, cols: list[str]) -> str:
    return f"""SELECT "column", chi2, dof, {_EVEN_TAIL} AS p FROM ({_chi_sql(source, target, cols)}) AS c"""


_CHI_P = union([
    f"SELECT 'lineitem' AS dataset, * FROM ({_chi_sql('lineitem', 'l_linestatus', ['l_returnflag'])}) AS a",
    f"SELECT 'orders' AS dataset, * FROM ({_chi_sql('orders', 'o_orderstatus', ['o_orderpriority'])}) AS b",
])
QUERIES["chi2_p_values"] = lambda s, d: rounded(
    hypothesis.with_chi2_pvalue(hypothesis.chi_square(table(s, d, "lineitem"), "l_linestatus", ["l_returnflag"]))
    .withColumn("dataset", F.lit("lineitem"))
    .unionByName(
        hypothesis.with_chi2_pvalue(hypothesis.chi_square(table(s, d, "orders"), "o_orderstatus", ["o_orderpriority"]))
        .withColumn("dataset", F.lit("orders"))
    ).select("dataset", "column", "chi2", "dof", "p_value"), 6)
ORACLE["chi2_p_values"] = f"""SELECT dataset, "column", {rnd("chi2", 6)} AS chi2, dof, {rnd(_EVEN_TAIL, 6)} AS p_value FROM ({_CHI_P}) AS c"""

QUERIES["significance_codes"] = lambda s, d: hypothesis.with_chi2_pvalue(
    hypothesis.chi_square(table(s, d, "orders"), "o_orderstatus", ["o_orderpriority"])
).select("column", "significance")
ORACLE["significance_codes"] = f"""SELECT "column", CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance
FROM (SELECT "column", {_EVEN_TAIL} AS p FROM ({_chi_sql("orders", "o_orderstatus", ["o_orderpriority"])}) AS c) AS q"""


def _anova_sql(source: str, target: str, cols: list[str]) -> str:
    return union(
        f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS n, count(*) AS groups,
  (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f,
  count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within
FROM (SELECT *, (SELECT avg({c}) FROM {source} WHERE {target} IS NOT NULL) AS g FROM (
  SELECT {target}, count({c}) AS n, avg({c}) AS m, var_pop({c}) * count({c}) AS ss FROM {source}
  WHERE {target} IS NOT NULL AND {c} IS NOT NULL GROUP BY {target}) AS k) AS q"""
        for c in cols
    )


# With three groups the upper tail of F is (1 + 2 F / d2) ^ (-d2 / 2).
QUERIES["anova_f"] = lambda s, d: rounded(
    hypothesis.with_f_pvalue(hypothesis.anova(table(s, d, "lineitem"), "l_returnflag", MEASURES)), 6)
ORACLE["anova_f"] = f"""SELECT "column", n, groups, {rnd("f", 6)} AS f, df_between, df_within,
  {rnd("pow(1 + 2 * f / df_within, -df_within / 2.0)", 6)} AS p_value FROM ({_anova_sql("lineitem", "l_returnflag", MEASURES)}) AS q"""


def _kruskal_sql(source: str, target: str, cols: list[str]) -> str:
    return union(
        f"""SELECT '{c}' AS "column", CAST(max(total) AS BIGINT) AS n, count(*) AS groups,
  (12.0 / (max(total) * (max(total) + 1.0)) * sum(rs * rs / nn) - 3 * (max(total) + 1)) / max(fix) AS h, count(*) - 1 AS dof
FROM (SELECT t, sum(rk) AS rs, count(*) AS nn FROM
   (SELECT {target} AS t, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk FROM {source}
    WHERE {c} IS NOT NULL AND {target} IS NOT NULL) AS a GROUP BY t) AS b,
  (SELECT CAST(sum(k) AS DOUBLE) AS total, 1 - sum(CAST(k AS DOUBLE) * k * k - k) / (pow(CAST(sum(k) AS DOUBLE), 3) - sum(k)) AS fix FROM
   (SELECT count(*) AS k FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL GROUP BY {c}) AS d) AS e"""
        for c in cols
    )


QUERIES["kruskal_h"] = lambda s, d: rounded(
    hypothesis.with_h_pvalue(hypothesis.kruskal(table(s, d, "lineitem"), "l_returnflag", MEASURES)), 6)
ORACLE["kruskal_h"] = f"""SELECT "column", n, groups, {rnd("h", 6)} AS h, dof, {rnd("exp(-h / 2)", 6)} AS p_value
FROM ({_kruskal_sql("lineitem", "l_returnflag", MEASURES)}) AS q"""

QUERIES["kruskal_h_distributed"] = lambda s, d: rounded(
    hypothesis.kruskal(lineitem_gaps(s, d), "l_linestatus", MEASURES, small=False))
ORACLE["kruskal_h_distributed"] = f"""SELECT "column", n, groups, {rnd("h")} AS h, dof FROM ({_kruskal_sql(GAPS, "l_linestatus", MEASURES)}) AS q"""

_ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
QUERIES["normality_sample"] = lambda s, d: rounded(
    hypothesis.normality_sample(lineitem_gaps(s, d), MEASURES, keys=_ROW_KEY).groupBy("column")
    .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")))
ORACLE["normality_sample"] = union(
    f"""SELECT '{c}' AS "column", count(*) AS n, {rnd("avg(x)")} AS mean, {rnd("max(x)")} AS top FROM (
  SELECT {c} AS x FROM (SELECT *, concat_ws('|', {", ".join(_ROW_KEY)}) AS k FROM {GAPS}) AS r WHERE {c} IS NOT NULL
  ORDER BY substr(md5(concat_ws('|', k, '42')), 1, 8), k LIMIT 500) AS q"""
    for c in MEASURES
)

# A column drawn from the normal distribution by the digest of the row key (Box and Muller), rounded so that values tie.
def _with_bell(s, d):
    key = F.md5(F.concat_ws("|", *_ROW_KEY))
    unit = lambda at: (F.conv(F.substring(key, at, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    bell = F.round(F.sqrt(F.lit(-2.0) * F.log(unit(1))) * F.cos(F.lit(6.283185307179586) * unit(9)), 3)
    return lineitem_gaps(s, d).withColumn("bell", bell)


_UNIT = "(CAST('0x' || substr(md5(concat_ws('|', {keys})), {at}, 8) AS BIGINT) + 5e-1) / 4294967296e0"
_BELL = f"""(SELECT *, round(sqrt(-2e0 * ln({_UNIT.format(keys=", ".join(_ROW_KEY), at=1)})) * cos(6.283185307179586 * {_UNIT.format(keys=", ".join(_ROW_KEY), at=9)}), 3) AS bell
  FROM {GAPS}) AS belled"""
_SHAPES = [*MEASURES, "bell"]

# Tail of the normal distribution beyond z by its series around zero, which is long enough for |z| < 8.
_TAIL = """CASE WHEN z > 8 THEN 0e0 WHEN z < -8 THEN 1e0 ELSE 5e-1 - sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120),
  lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 15e-1) + ln(pi()) / 2))) END"""


def _normality_sql(source: str, cols: list[str]) -> str:
    # Average ranks by window functions over single rows.
    fits = union(f"""SELECT '{c}' AS "column", {i} AS position, count(*) AS n, pow(corr(x, m), 2) AS w FROM (
  SELECT x, {normal_quantile_sql("p")} AS m FROM (
    SELECT {c} AS x, (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 - 375e-3) / (count(*) OVER () + 25e-2) AS p
    FROM {source} WHERE {c} IS NOT NULL) AS r) AS s""" for i, c in enumerate(cols))
    return f"""SELECT *, CASE WHEN p_value > 0.05 THEN 'ANOVA' ELSE 'Kruskal-Wallis' END AS test FROM (SELECT "column", position, n, w, {_TAIL} AS p_value FROM (
  SELECT *, (ln(1 - w) + 1.2725 - 1.0521 * (ln(ln(n)) - ln(n))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS z FROM ({fits}) AS f) AS g) AS h"""


# Shapiro-Wilk on the sample has no SQL.
QUERIES["normality"] = lambda s, d: hypothesis.normality(_with_bell(s, d), _SHAPES, keys=_ROW_KEY)
for _name, _small in (("normality_all_rows", None), ("normality_distributed", False)):
    QUERIES[_name] = lambda s, d, small=_small: rounded(
        hypothesis.normality(_with_bell(s, d), _SHAPES, keys=_ROW_KEY, small=small).select("column", "position", "n", "w", "p_value", "test"), 6)
    ORACLE[_name] = f"""SELECT "column", position, n, {rnd("w", 6)} AS w, {rnd("p_value", 6)} AS p_value, test FROM ({_normality_sql(_BELL, _SHAPES)}) AS q"""


def _recommended(s, d):
    df = _with_bell(s, d).withColumn("l_returnflag", F.coalesce("l_returnflag", F.lit("N")))
    return rounded(hypothesis.recommended_tests(df, "l_returnflag", hypothesis.normality(df, _SHAPES, keys=_ROW_KEY), _SHAPES), 6)


# Three classes: the tails of F and of chi-square have closed forms.
_THREE = f"(SELECT * REPLACE (coalesce(l_returnflag, 'N') AS l_returnflag) FROM {_BELL}) AS three"
QUERIES["recommended_tests"] = _recommended
ORACLE["recommended_tests"] = f"""SELECT r."column", r.test, {rnd("CASE WHEN r.test = 'ANOVA' THEN f ELSE h END", 6)} AS statistic,
  {rnd("CASE WHEN r.test = 'ANOVA' THEN pow(1 + 2 * f / df_within, -df_within / 2e0) ELSE exp(-h / 2) END", 6)} AS p_value
FROM ({_normality_sql(_THREE, _SHAPES)}) AS r JOIN ({_anova_sql(_THREE, "l_returnflag", _SHAPES)}) AS a USING ("column")
JOIN ({_kruskal_sql(_THREE, "l_returnflag", _SHAPES)}) AS k USING ("column")"""


# --- leakage by correlation with the class code -----------------------------
def _planted(s, d):
    return table(s, d, "lineitem").withColumn(
        "copy", F.when(F.col("l_linestatus") == "O", F.lit(1.0)).otherwise(F.lit(0.0)) + F.col("l_tax"))


QUERIES["scalar_leakage"] = lambda s, d: rounded(
    leakage.scalar_leaks(_planted(s, d), "l_linestatus", [*MEASURES, "copy"]).withColumn("leak", F.abs("r") > 0.95))
ORACLE["scalar_leakage"] = union(
    f"""SELECT '{c}' AS "column", {rnd(f"corr({c}, code)")} AS r, abs(corr({c}, code)) > 0.95 AS leak FROM
  (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END + l_tax AS copy, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS code FROM lineitem) AS q"""
    for c in [*MEASURES, "copy"]
)


# --- missing rate over all tables, bias risk --------------------------------
_FOLDER = ("customer", "supplier", "nation", "region", "part", "orders", "events", "documents")


def _folder(s, d):
    return {**{t: table(s, d, t) for t in _FOLDER}, "lineitem": lineitem_gaps(s, d)}


def _size_sql(name: str, source: str) -> str:
    cols = COLUMNS[name]
    gaps = " + ".join(f"(count(*) - count({c}))" for c in cols)
    return f"""SELECT '{name}' AS "table", count(*) AS "rows", CAST({len(cols)} AS BIGINT) AS cols,
  CAST({gaps} AS BIGINT) AS missing, count(*) * {len(cols)} AS cells FROM {source}"""


_SIZES = union([_size_sql(t, t) for t in _FOLDER] + [_size_sql("lineitem", GAPS)])
QUERIES["folder_missing_rate"] = lambda s, d: evidence.table_sizes(_folder(s, d))
ORACLE["folder_missing_rate"] = _SIZES

QUERIES["bias_score"] = lambda s, d: rounded(evidence.rollup(evidence.table_sizes(_folder(s, d))), 6)
ORACLE["bias_score"] = f"""SELECT count(*) AS file_count, CAST(sum("rows") AS BIGINT) AS "rows", CAST(floor(avg(cols)) AS BIGINT) AS cols,
  {rnd("sum(missing) * 1.0 / sum(cells)", 6)} AS missing_rate,
  {rnd("least(45, greatest(5, sum(missing) * 100.0 / sum(cells) + floor(avg(cols)) * 0.2))", 6)} AS potential_bias FROM ({_SIZES}) AS t"""
