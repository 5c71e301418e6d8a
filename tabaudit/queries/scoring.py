"""Metric and model queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabaudit.config import AUDIT, DESKTOP
from tabaudit.operators import encoding, isolation, leakage, metrics, modelling
from tabaudit.operators.chartdata import feature_network
from tabaudit.operators.scale import spread
from tabaudit.plans import audit as audits
from tabaudit.plans.research import report_lines, research
from tabaudit.plans.results import results
from tabaudit.queries.common import MEASURES, rnd, rounded, table, union
from tabaudit.queries.judgement import chi_even_sql, t_even_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# --- metrics of a fixed score over lineitem ---------------------------------
_SCORE = "(l_discount * 5 + l_tax * 3 + l_quantity / 200.0 + CASE WHEN l_returnflag = 'R' THEN 0.05 ELSE 0.0 END)"


def _scored(s, d):
    return table(s, d, "lineitem").select(
        F.expr(f"CAST({_SCORE} AS DOUBLE)").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


_SCORED = f"(SELECT round(CAST({_SCORE} AS DOUBLE), 9) AS score, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem) AS scored"


def _auc_sql(source: str, extra: str = "") -> str:
    return f"""SELECT {extra} CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives,
  (sum(label * rk) - sum(label) * (sum(label) + 1.0) / 2) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS auc
FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM {source}) AS r"""


def _near(df):
    return df.withColumn("score", F.round("score", 9))


QUERIES["auc_binary"] = lambda s, d: rounded(metrics.auc(_near(_scored(s, d)), "label", "score"), 8)
ORACLE["auc_binary"] = f"SELECT positives, negatives, {rnd('auc', 8)} AS auc FROM ({_auc_sql(_SCORED)}) AS q"

QUERIES["auc_binary_distributed"] = lambda s, d: rounded(metrics.auc(_near(_scored(s, d)), "label", "score", small=False), 8)
ORACLE["auc_binary_distributed"] = ORACLE["auc_binary"]

# Three classes, three scores.
_CLASSES = ("A", "N", "R")
_MULTI = {"s0": "l_discount", "s1": "l_tax", "s2": "(l_quantity / 50.0 + CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0.0 END)"}


def _multi(s, d):
    return table(s, d, "lineitem").select(
        (F.array_position(F.array(*map(F.lit, _CLASSES)), F.col("l_returnflag")) - 1).cast("int").alias("label"),
        *[F.round(F.expr(f"CAST({v} AS DOUBLE)"), 9).alias(k) for k, v in _MULTI.items()])


_OVR = union(
    _auc_sql(f"(SELECT round(CAST({v} AS DOUBLE), 9) AS score, CAST(l_returnflag = '{c}' AS INT) AS label FROM lineitem) AS m", f"{i} AS \"class\",")
    for i, (c, v) in enumerate(zip(_CLASSES, _MULTI.values()))
)
QUERIES["auc_one_vs_rest"] = lambda s, d: rounded(metrics.auc_per_class(_multi(s, d), "label", list(_MULTI)), 8)
ORACLE["auc_one_vs_rest"] = f"SELECT \"class\", positives, negatives, {rnd('auc', 8)} AS auc FROM ({_OVR}) AS q"

QUERIES["auc_macro"] = lambda s, d: rounded(metrics.auc_macro(_multi(s, d), "label", list(_MULTI)), 8)
ORACLE["auc_macro"] = f"SELECT count(*) AS classes, {rnd('avg(auc)', 8)} AS auc FROM ({_OVR}) AS q"

# Calibration of the score, twenty quantile bins.
_EDGES = ", ".join(f"quantile_cont(score, {i / 20}) AS e{i}" for i in range(1, 20))
_BIN = " + ".join(f"CAST(e{i} < score AS INT)" for i in range(1, 20))
_CURVE = f"""SELECT {_BIN} AS bin, count(*) AS n, avg(score) AS mean_predicted, avg(CAST(label AS DOUBLE)) AS fraction_positive
FROM {_SCORED}, (SELECT {_EDGES} FROM {_SCORED}) AS e GROUP BY 1"""
QUERIES["calibration_curve"] = lambda s, d: rounded(metrics.calibration_curve(_near(_scored(s, d)), "label", "score"), 6)
ORACLE["calibration_curve"] = f"""SELECT bin, n, {rnd("mean_predicted", 6)} AS mean_predicted, {rnd("fraction_positive", 6)} AS fraction_positive FROM ({_CURVE}) AS c"""

QUERIES["calibration_curve_distributed"] = lambda s, d: rounded(
    metrics.calibration_curve(_near(_scored(s, d)), "label", "score", small=False), 6)
ORACLE["calibration_curve_distributed"] = ORACLE["calibration_curve"]

QUERIES["calibration_error"] = lambda s, d: rounded(
    metrics.calibration_error(metrics.calibration_curve(_near(_scored(s, d)), "label", "score")), 6)
ORACLE["calibration_error"] = f"""SELECT CAST(sum(n) AS BIGINT) AS n, {rnd("sum(abs(mean_predicted - fraction_positive) * n) / sum(n)", 6)} AS ece,
  {rnd("max(abs(mean_predicted - fraction_positive))", 6)} AS mce FROM ({_CURVE}) AS c"""


# --- models (no SQL: forests and calibration are iterative) -----------------
def labelled_documents(s, d):
    """Documents with simple text measures and their quality label, last column."""
    docs = spread(table(s, d, "documents"))
    words = F.size(F.split(F.trim("text"), r"\s+"))
    lines = F.size(F.split("text", "\n"))
    measures = docs.select(
        "doc_id", "lang", "source", "n_chars", words.alias("n_words"), lines.alias("n_lines"),
        F.regexp_count("text", F.lit(r"[0-9]")).alias("n_digits"), F.regexp_count("text", F.lit(r"[A-ZÀ-Ý]")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"[^\w\s]")).alias("n_marks"),
        F.size(F.array_distinct(F.split(F.lower(F.trim("text")), r"\s+"))).alias("n_unique"),
    ).withColumn("share_unique", F.col("n_unique") / F.col("n_words"))
    return measures.join(table(s, d, "labels"), "doc_id").select(*measures.columns, "toxic", "quality")


QUERIES["calibrated_audit"] = lambda s, d: audits.audit(labelled_documents(s, d), "documents", keys=["doc_id"]).report


def _desktop(s, d):
    df = table(s, d, "orders").withColumn("month", F.month("o_orderdate")).select("o_totalprice", "month", "o_orderstatus", "o_orderpriority")
    return audits.audit(df, "orders", DESKTOP).report


QUERIES["multiclass_audit"] = _desktop


def _returned(s, d):
    """lineitem with a two-class outcome in the last column."""
    return table(s, d, "lineitem").select(
        *MEASURES, "l_linenumber", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("shipped"),
        "l_returnflag", "l_linestatus")


QUERIES["rf_leakage"] = lambda s, d: leakage.model_importances(
    _returned(s, d).withColumn("copy", F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)), "l_linestatus",
    [*MEASURES, "copy", "l_returnflag"], AUDIT).withColumn("leak", F.col("importance") > AUDIT.leak_importance)


# A copy of the outcome takes more than the allowed share of the forest.
def _verdict(s, d):
    df = _returned(s, d).withColumns({
        "copy": F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0) + F.col("l_tax"),
        "echo": F.when(F.col("l_linestatus") == "O", F.lit("yes")).otherwise(F.lit("no"))})
    names = [*MEASURES, "copy", "echo", "l_returnflag"]
    kept, removed = leakage.hunt(df, "l_linestatus", names, AUDIT)
    rows = [(c, "kept") for c in kept] + [(c, reason) for c, reason, _ in removed]
    return s.createDataFrame(rows, "predictor string, verdict string")


QUERIES["leakage_verdict"] = _verdict
ORACLE["leakage_verdict"] = union(
    [f"""SELECT '{c}' AS predictor, CASE WHEN abs(corr({c}, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END)) > 0.95 THEN 'correlation' ELSE 'kept' END AS verdict
FROM (SELECT *, CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.0 END + l_tax AS copy FROM lineitem) AS q""" for c in [*MEASURES, "copy"]]
    + ["SELECT 'echo' AS predictor, 'importance' AS verdict", "SELECT 'l_returnflag' AS predictor, 'kept' AS verdict"]
)


def _importances(s, d):
    df = labelled_documents(s, d)
    labels = encoding.target_labels(df, "quality")
    inputs = encoding.features(df, ["lang", "source", "n_chars", "n_words", "n_lines", "n_digits", "n_upper", "n_marks", "share_unique"])
    data = modelling.model_table(df, "quality", labels, inputs, ["doc_id"])
    forest = modelling.fit_forest(data.where("u < 0.6"), 50, 10)
    return modelling.importance_table(s, inputs, forest.featureImportances.toArray())


QUERIES["rf_importance_topk"] = lambda s, d: modelling.top_features(_importances(s, d), 15)
QUERIES["feature_network"] = lambda s, d: feature_network(modelling.top_features(_importances(s, d), 15), "quality")

QUERIES["isolation_forest_scores"] = lambda s, d: isolation.outlier_scores(
    table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *MEASURES), MEASURES,
    keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
).groupBy("is_outlier").agg(F.count(F.lit(1)).alias("n"), F.avg("anomaly_score").alias("mean_score"))


# The cut is the 95% quantile of all scores, so the number of removed rows is known without them.
def _share(s, d):
    df = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    kept = isolation.remove_outliers(df, ["o_totalprice", "o_custkey"], keys=["o_orderkey"])
    counts = kept.agg(F.count(F.lit(1)).alias("kept")).withColumn(
        "n", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    return counts.select("n", (F.col("n") - F.col("kept")).alias("removed"))


QUERIES["isolation_forest_share"] = _share
ORACLE["isolation_forest_share"] = "SELECT count(*) AS n, count(*) - 1 - CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) AS removed FROM orders"

QUERIES["research_findings"] = lambda s, d: research(labelled_documents(s, d).drop("doc_id"), "documents").predictors
QUERIES["research_report"] = lambda s, d: report_lines(research(labelled_documents(s, d).drop("doc_id"), "documents"))
QUERIES["results_summary"] = lambda s, d: results(table(s, d, "lineitem").select(*MEASURES, "l_returnflag", "l_linestatus"), "l_linestatus")["summary"]
# All tests here have an even number of degrees of freedom, so p is a finite sum.
_LINE = """rpad({0}, 30, ' ') || ' ' || rpad('{1}', 10, ' ') || ' ' || format('{{:.4f}}', p) || '     ' ||
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS line"""
ORACLE["results_summary"] = f"""SELECT {_LINE.format('"column"', 'T-Test')} FROM ({t_even_sql("lineitem", "l_linestatus", MEASURES, "F", "O")}) AS t
UNION ALL SELECT {_LINE.format('"column"', 'Chi2')} FROM ({chi_even_sql("lineitem", "l_linestatus", ["l_returnflag"])}) AS c"""


def _batch(s, d):
    tables = {
        "documents": labelled_documents(s, d).drop("doc_id"),
        "embeddings": table(s, d, "embeddings"),
        "part": table(s, d, "part"),
    }
    return audits.audit_many(s, tables, try_fusion=False)[1].select("file", "status")


# A table is skipped when neither its last nor its first column has 2 to 10 values;
# embeddings have a label, but nothing else to predict it from than an identifier.
QUERIES["audit_batch_log"] = _batch
ORACLE["audit_batch_log"] = """SELECT 'documents' AS file, CASE WHEN count(DISTINCT quality) BETWEEN 2 AND 10 THEN 'SUCCESS' ELSE 'SKIPPED' END AS status FROM labels
UNION ALL SELECT 'embeddings', CASE WHEN count(DISTINCT label) BETWEEN 2 AND 10 THEN 'FAILED' ELSE 'SKIPPED' END FROM embeddings
UNION ALL SELECT 'part', CASE WHEN count(DISTINCT p_retailprice) BETWEEN 2 AND 10 OR count(DISTINCT p_partkey) BETWEEN 2 AND 10 THEN 'SUCCESS' ELSE 'SKIPPED' END FROM part"""
