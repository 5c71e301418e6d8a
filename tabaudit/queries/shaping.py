"""Structure, cleaning, encoding and sampling queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.config import AUDIT, RESEARCH
from tabaudit.operators import cleaning, encoding, profiling, scale, structure
from tabaudit.queries.common import COLUMNS, GAPS, MEASURES, NUMERIC, TEXT, lineitem_gaps, rnd, rounded, table, union

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# --- target and predictors --------------------------------------------------
_TARGETS = ("customer", "orders", "part", "lineitem", "events", "labels", "supplier")


def _targets(s, d):
    rows = []
    for name in _TARGETS:
        found = structure.analyse_structure(table(s, d, name))
        rows.append((name, found.target))
    return s.createDataFrame(rows, "dataset string, target string")


QUERIES["target_detect"] = _targets
ORACLE["target_detect"] = union(
    f"""SELECT '{t}' AS dataset, CASE WHEN count(DISTINCT {COLUMNS[t][-1]}) BETWEEN 2 AND 10 THEN '{COLUMNS[t][-1]}'
  WHEN count(DISTINCT {COLUMNS[t][0]}) BETWEEN 2 AND 10 THEN '{COLUMNS[t][0]}' END AS target FROM {t}"""
    for t in _TARGETS
)


def _binary(s, d):
    rows = []
    for name in _TARGETS:
        df = table(s, d, name)
        sizes = profiling.small_distinct_counts(df, df.columns, 2)
        rows.append((name, structure.choose_binary_target(df.columns, sizes.__getitem__)))
    return s.createDataFrame(rows, "dataset string, target string")


QUERIES["target_detect_binary"] = _binary
ORACLE["target_detect_binary"] = union(
    "SELECT '%s' AS dataset, CASE %s ELSE '%s' END AS target FROM %s" % (
        t, " ".join(f"WHEN count(DISTINCT {c}) = 2 THEN '{c}'" for c in COLUMNS[t]), COLUMNS[t][-1], t)
    for t in _TARGETS
)


def _predictors(s, d):
    rows = []
    for name, target in (("orders", "o_orderpriority"), ("lineitem", "l_linestatus"), ("events", "event_type")):
        for label, profile in (("audit", AUDIT), ("research", RESEARCH)):
            rows += [(name, label, c) for c in structure.choose_predictors(table(s, d, name), target, profile)]
    return s.createDataFrame(rows, "dataset string, profile string, predictor string")


def _predictor_sql() -> str:
    # Names holding ID, DATE, TEXT, DESC (and for the audit a few more) are out.
    parts = []
    for t, target in (("orders", "o_orderpriority"), ("lineitem", "l_linestatus"), ("events", "event_type")):
        for c in COLUMNS[t]:
            if c == target or any(f in c.upper() for f in ("ID", "DATE", "TEXT", "DESC")):
                continue
            if c in TEXT[t]:
                parts.append(f"SELECT '{t}' AS dataset, 'audit' AS profile, '{c}' AS predictor FROM {t} HAVING count(DISTINCT {c}) <= 50")
            else:
                parts.append(f"SELECT '{t}' AS dataset, 'audit' AS profile, '{c}' AS predictor")
            parts.append(f"SELECT '{t}' AS dataset, 'research' AS profile, '{c}' AS predictor FROM {t} HAVING count(DISTINCT {c}) < 100")
    return union(parts)


QUERIES["predictor_select"] = _predictors
ORACLE["predictor_select"] = _predictor_sql()


def _decoded(s, d):
    df = table(s, d, "lineitem").select(
        F.col("l_linenumber").alias("CVDSTRK3"), F.col("l_quantity").alias("_BMI5"), F.col("l_orderkey").alias("row_id"),
        F.col("l_linestatus").alias("class"), F.col("l_returnflag").alias("classes"))
    df = df.drop(*structure.artifact_columns(df.columns))
    df = df.withColumnsRenamed(structure.codebook_renames(df.columns))
    return df.groupBy("TARGET_CLASS", "classes").agg(
        F.sum("TARGET_STROKE").alias("TARGET_STROKE"), F.sum("_BMI5").alias("_BMI5"))


QUERIES["codebook_rename"] = _decoded
ORACLE["codebook_rename"] = """SELECT l_linestatus AS "TARGET_CLASS", l_returnflag AS classes,
  CAST(sum(l_linenumber) AS BIGINT) AS "TARGET_STROKE", sum(l_quantity) AS "_BMI5" FROM lineitem GROUP BY 1, 2"""


def _sparse(s, d):
    df = table(s, d, "lineitem").select("l_linestatus", F.when(F.col("l_returnflag") == "R", F.lit("Y")).alias("DIED"))
    return structure.repair_sparse_outcomes(df).groupBy("l_linestatus", "DIED").agg(F.count(F.lit(1)).alias("n"))


QUERIES["sparse_outcome_fill"] = _sparse
ORACLE["sparse_outcome_fill"] = """SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS "DIED", count(*) AS n
FROM lineitem GROUP BY 1, 2"""


def _survey(s, d):
    df = table(s, d, "lineitem").withColumn(
        "answer", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(9))
    if structure.has_survey_codes(df, "answer"):
        df = structure.recode_yes_no(df, "answer")
    return rounded(df.groupBy("answer", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


QUERIES["yes_no_recode"] = _survey
ORACLE["yes_no_recode"] = f"""SELECT CAST(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END AS BIGINT) AS answer, l_linestatus, count(*) AS n,
  {rnd("sum(l_quantity)")} AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2"""


# The first five values in row order; the events file is ordered by event_id.
def _first_values(s, d):
    values = structure.first_values(table(s, d, "events"), "user_id")
    return s.createDataFrame(list(enumerate(values)), "place int, user_id bigint")


QUERIES["first_values"] = _first_values
ORACLE["first_values"] = """SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS place, user_id FROM
  (SELECT user_id, min(event_id) AS f FROM events GROUP BY user_id ORDER BY f LIMIT 5) AS q"""

# --- imputation -------------------------------------------------------------
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _med(c: str) -> str:
    return f"coalesce({c}, (SELECT coalesce(median({c}), 0) FROM {GAPS}))"


QUERIES["median_impute"] = lambda s, d: rounded(
    cleaning.impute_median(lineitem_gaps(s, d).select(*_KEYS, *MEASURES), MEASURES))
ORACLE["median_impute"] = f"""SELECT {", ".join(_KEYS)}, {", ".join(f"{rnd(_med(c))} AS {c}" for c in MEASURES)} FROM {GAPS}"""

QUERIES["categorical_impute"] = lambda s, d: cleaning.impute_text(lineitem_gaps(s, d).select(*_KEYS, "l_returnflag", "l_linestatus"))
ORACLE["categorical_impute"] = f"""SELECT {", ".join(_KEYS)}, coalesce(l_returnflag, 'Unknown') AS l_returnflag, l_linestatus FROM {GAPS}"""

QUERIES["zero_impute"] = lambda s, d: rounded(cleaning.impute_zero(lineitem_gaps(s, d).select(*_KEYS, *MEASURES)))
ORACLE["zero_impute"] = f"""SELECT {", ".join(_KEYS)}, {", ".join(f"{rnd(f'coalesce({c}, 0)')} AS {c}" for c in MEASURES)} FROM {GAPS}"""

QUERIES["drop_empty_columns"] = lambda s, d: cleaning.drop_empty_columns(
    table(s, d, "orders").withColumns({"blank": F.when(F.col("o_orderkey") < 0, F.lit("x")), "void": F.when(F.col("o_custkey") < 0, F.lit(1.0))})
).drop("o_orderdate")
ORACLE["drop_empty_columns"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"

QUERIES["complete_cases"] = lambda s, d: cleaning.complete_cases(
    lineitem_gaps(s, d).select(*_KEYS, *MEASURES, "l_returnflag"), [*MEASURES, "l_returnflag"])
ORACLE["complete_cases"] = f"""SELECT {", ".join(_KEYS + MEASURES)}, l_returnflag FROM {GAPS}
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*MEASURES, "l_returnflag"])}"""

# --- encoding ---------------------------------------------------------------
QUERIES["label_encode"] = lambda s, d: encoding.label_encode(
    encoding.label_encode(table(s, d, "orders"), "o_orderpriority", "priority_code"), "o_orderstatus", "status_code"
).select("o_orderkey", "priority_code", "status_code")
ORACLE["label_encode"] = """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS priority_code,
  dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS status_code FROM orders"""

# More labels than are inlined: the dictionary is numbered in range buckets and joined.
QUERIES["label_encode_joined"] = lambda s, d: encoding.label_encode(
    table(s, d, "customer"), "c_name", "name_code", small=False).select("c_custkey", "name_code")
ORACLE["label_encode_joined"] = "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS name_code FROM customer"

QUERIES["one_hot_drop_first"] = lambda s, d: encoding.one_hot(table(s, d, "customer"), "c_mktsegment", keep=["c_custkey"])
ORACLE["one_hot_drop_first"] = "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS INT) AS \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM customer"

QUERIES["standard_scale"] = lambda s, d: rounded(
    encoding.standard_scale(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 6)
ORACLE["standard_scale"] = f"""SELECT o_orderkey, {rnd("(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)", 6)} AS o_totalprice FROM orders"""


# --- sampling, split, ordering, sets ----------------------------------------
def _hash_sql(key: str, salt: str = "42") -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {key}, '{salt}')), 1, 8) AS BIGINT) / 4294967296.0)"


QUERIES["hash_split"] = lambda s, d: encoding.hash_split(table(s, d, "orders"), ["o_orderkey"]).select("o_orderkey", "part")
ORACLE["hash_split"] = f"""SELECT o_orderkey, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.7 THEN 'calibrate' ELSE 'test' END AS part
FROM (SELECT o_orderkey, {_hash_sql("CAST(o_orderkey AS VARCHAR)")} AS u FROM orders) AS q"""

QUERIES["hash_sample"] = lambda s, d: scale.smallest_by_hash(table(s, d, "orders"), 500, ["o_orderkey"]).select("o_orderkey", "o_totalprice")
ORACLE["hash_sample"] = f"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_hash_sql("CAST(o_orderkey AS VARCHAR)")}, o_orderkey LIMIT 500"""

QUERIES["hash_sample_by_class"] = lambda s, d: scale.smallest_by_hash(
    table(s, d, "orders"), 100, ["o_orderkey"], by=["o_orderpriority"]).select("o_orderpriority", "o_orderkey")
ORACLE["hash_sample_by_class"] = f"""SELECT o_orderpriority, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_hash_sql("CAST(o_orderkey AS VARCHAR)")}, o_orderkey) <= 100"""

QUERIES["top_k"] = lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")
ORACLE["top_k"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15"

QUERIES["union_chunks"] = lambda s, d: rounded(
    table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    .unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)
    .groupBy("nation", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("balance")))
ORACLE["union_chunks"] = f"""SELECT nation, segment, count(*) AS n, {rnd("sum(balance)")} AS balance FROM
 (SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier) AS u GROUP BY 1, 2"""

QUERIES["key_intersection"] = lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("key")).intersect(
    table(s, d, "customer").select(F.col("c_custkey").alias("key")))
ORACLE["key_intersection"] = "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer"
