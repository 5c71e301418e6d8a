import pytest
from pyspark.sql import functions as F

from tabaudit.config import AUDIT, DESKTOP, RESEARCH
from tabaudit.operators import cleaning, encoding, structure


def _pick(names, sizes=None, profile=AUDIT):
    renamed = structure.codebook_renames(names)
    names = [renamed.get(n, n) for n in names]
    return structure.choose_target(names, lambda c: (sizes or {}).get(c, 99), profile)


def test_codebook():
    names = ["CVDSTRK3", "Stroke", "_MICHD", "class", "classes", "BMI"]
    assert structure.codebook_renames(names) == {
        "CVDSTRK3": "TARGET_STROKE", "_MICHD": "TARGET_HEART_DISEASE", "class": "TARGET_CLASS"}


def test_targets_of_known_datasets():
    assert _pick(["_STATE", "CVDSTRK3"]) == "TARGET_STROKE"
    assert _pick(["_STATE", "CVDSTRK3", "_MICHD"]) == "TARGET_HEART_DISEASE"
    assert _pick(["Diabetes_binary", "HighBP", "Stroke"]) == "TARGET_STROKE"
    assert _pick(["PhysicalHealthDays", "HadHeartAttack", "State"], {"TARGET_HEART_ATTACK": 2}) == "TARGET_HEART_ATTACK"
    assert _pick(["VAERS_ID", "DIED", "AGE_YRS"]) == "DIED"
    assert _pick(["a", "target"]) == "target"
    assert _pick(["deathyn", "x"]) == "deathyn"
    assert _pick(["deathyn", "x"], profile=RESEARCH) is None
    assert _pick(["a", "b"], {"b": 3}) == "b"
    assert _pick(["a", "b"], {"a": 2, "b": 50}) == "a"
    assert _pick(["a", "b"]) is None


def test_binary_target():
    sizes = {"a": 5, "b": 2, "c": 2}.get
    assert structure.choose_binary_target(["a", "b", "c"], sizes) == "b"
    assert structure.choose_binary_target(["a", "Outcome"], lambda c: 9) == "Outcome"
    assert structure.choose_binary_target(["a", "OUTCOME"], lambda c: 9) == "OUTCOME"


def test_artifacts_and_leaky_names():
    assert structure.artifact_columns(["Unnamed: 0", "_c0", "ID", "row_id", "age"]) == ["Unnamed: 0", "_c0", "ID", "row_id"]
    assert structure.artifact_columns(["row_id", "id"], DESKTOP.artifact_names) == ["id"]
    names = ["WIDTH", "COVID_FLAG", "VAX_DATE", "BMI", "y"]
    assert structure.leaky_names(names, "y") == ["WIDTH", "COVID_FLAG", "VAX_DATE"]
    assert "STROKE_AGE" in structure.leaky_names(["STROKE_AGE", "BMI"], "TARGET_HEART_DISEASE")
    assert "NUMDAYS" in structure.leaky_names(["NUMDAYS", "BMI"], "DIED")


def test_recode_keeps_yes_and_no(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (7, 30), (9, 40), (None, 50)], "y int, x int")
    values = structure.first_values(df, "y")
    assert values == [1, 2, 7, 9] and structure.is_survey_coded(values)
    assert sorted(tuple(r) for r in structure.recode_yes_no(df, "y").collect()) == [(0, 20), (1, 10)]
    assert not structure.is_survey_coded([0, 1])
    assert not structure.is_survey_coded(["1", "2"])


def test_all_values_decide_on_the_recode(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 7, 55)], "y int").coalesce(1)
    assert not structure.has_survey_codes(df, "y") and structure.has_survey_codes(df.where("y < 55"), "y")
    assert not structure.has_survey_codes(df.where("y > 99"), "y")


def test_every_predictor_has_its_inputs(spark):
    df = spark.range(4).select(*[F.rand(i).alias(f"x{i}") for i in range(520)])
    assert len(encoding.features(df, df.columns)) == 520


def test_sparse_outcome(spark):
    df = spark.createDataFrame([("Y", "a"), (None, "b"), (None, None)], "DIED string, HOSPITALS string")
    rows = structure.repair_sparse_outcomes(df).collect()
    assert [r["DIED"] for r in rows] == ["Y", "N", "N"]
    assert [r["HOSPITALS"] for r in rows] == ["a", "b", None]


def test_predictors_and_held_columns(spark):
    df = spark.range(200).select(
        F.col("id").alias("key"), F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") % 3).cast("string").alias("kind"),
        F.col("id").alias("amount"), (F.col("id") % 2).alias("flag"))
    found = structure.analyse_structure(df, held=["key"])
    assert (found.target, found.predictors) == ("flag", ["kind", "amount"])
    assert "key" in found.df.columns
    assert structure.analyse_structure(df, RESEARCH).predictors == ["kind"]


def test_cleaning(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a", None, None), (2, None, None, None, None), (4, float("nan"), "b", None, None), (None, 4.0, "b", None, None)],
        "i int, x double, s string, e double, t string")
    assert cleaning.empty_columns(df) == ["e", "t"]
    out = cleaning.impute_text(cleaning.impute_median(cleaning.drop_empty_columns(df)))
    assert sorted((float(r["i"]), r["x"], r["s"]) for r in out.collect()) == [(1.0, 1.0, "a"), (2.0, 2.5, "Unknown"), (2.0, 4.0, "b"), (4.0, 2.5, "b")]
    half = cleaning.impute_median(spark.createDataFrame([(1,), (2,), (None,)], "i int"))
    assert sorted(r["i"] for r in half.collect()) == [1.0, 1.5, 2.0], "a fractional median must not be cut"
    zero = cleaning.impute_median(spark.createDataFrame([(None,)], "i int"))
    assert zero.first()["i"] == 0
    assert cleaning.complete_cases(df, ["x", "s"]).count() == 2


def test_features(spark):
    df = spark.createDataFrame([(1.0, "b", "k0"), (2.0, "a", "k1"), (None, "c", "k2")], "num double, cat string, many_values string")
    inputs = encoding.features(df, ["cat", "num", "many_values"], one_hot_max=10)
    assert [(f.name, f.source) for f in inputs] == [
        ("num", "num"), ("cat_b", "cat"), ("cat_c", "cat"), ("many_values_k1", "many_values"), ("many_values_k2", "many_values")]
    coded = encoding.features(df, ["cat", "num", "many_values"], one_hot_max=2)
    assert [f.name for f in coded] == ["cat", "num", "many_values"]
    assert [r[0] for r in df.select(coded[0].value).collect()] == [1.0, 0.0, 2.0]


@pytest.mark.parametrize("small", [True, False])
def test_label_codes(spark, small):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("z",)], "v string")
    got = {r["v"]: r["code"] for r in encoding.label_encode(df, "v", "code", small=small).collect()}
    assert got == {"a": 0, "b": 1, None: 2, "z": 3}
