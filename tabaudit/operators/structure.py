"""Schema rules: artefact columns, outcome names, target choice, predictor choice.

Names are decided on the driver from the schema; values are only looked at
through small aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.config import (
    AUDIT, BANNED_FOR_DEATH, BANNED_FOR_HEART, CODEBOOK, SPARSE_OUTCOMES, SURVEY_CODES,
    TARGET_CANDIDATES_EXACT, AuditProfile,
)
from tabaudit.functions.columns import col, scalar_columns, string_columns
from tabaudit.operators.profiling import small_distinct_counts


@dataclass
class Structure:
    """Result of the structure step."""

    df: DataFrame
    target: str | None
    predictors: list[str]
    dropped: list[str]
    renamed: dict[str, str]


def artifact_columns(names: Sequence[str], artifacts: Sequence[str] = AUDIT.artifact_names) -> list[str]:
    """Row numbers and unnamed columns (Spark calls an empty header ``_c<i>``)."""
    return [n for n in names if "Unnamed:" in n or re.fullmatch(r"_c\d+", n) or n.lower() in artifacts]


def codebook_renames(names: Sequence[str]) -> dict[str, str]:
    """Old -> new for coded outcome names; a standard name is given out once."""
    taken, out = set(names), {}
    for name in names:
        free = (std for pattern, std in CODEBOOK if std not in taken and re.match(pattern, name, re.IGNORECASE))
        standard = next(free, None)
        if standard:
            out[name] = standard
            taken = (taken - {name}) | {standard}
    return out


def sparse_outcome_columns(names: Sequence[str]) -> list[str]:
    return [n for n in names if any(o in n.upper() for o in SPARSE_OUTCOMES)]


def repair_sparse_outcomes(df: DataFrame, held: Sequence[str] = ()) -> DataFrame:
    """Outcome columns with at most one value: a missing cell means ``N``."""
    names = [c for c in sparse_outcome_columns(scalar_columns(df)) if c not in held]
    if not names:
        return df
    # Minimum equals maximum exactly when there is at most one value.
    row = df.agg(*[F.min(col(c)).eqNullSafe(F.max(col(c))).alias(f"s{i}") for i, c in enumerate(names)]).first()
    return df.withColumns(
        {c: F.coalesce(col(c).cast("string"), F.lit("N")) for i, c in enumerate(names) if row[f"s{i}"]}
    )


def choose_target(names: Sequence[str], distinct: Callable[[str], int], profile: AuditProfile = AUDIT) -> str | None:
    """Named target, else one containing TARGET, else the last or first column.

    ``distinct`` gives the number of values of a column; it is asked only for
    columns whose name made them candidates.
    """
    def usable(name: str) -> bool:
        return profile.target_min_classes <= distinct(name) <= profile.target_max_classes

    for wanted in profile.priority:
        forms = {wanted, wanted.replace("_", "")} if profile.priority_ignores_underscore else {wanted}
        hit = next((n for n in names if n.upper() in forms), None)
        if hit:
            return hit
    tail = [n for n in names if "TARGET" in n.upper()] if profile.substring_step else []
    candidates = tail + ([names[-1], names[0]] if names else [])
    return next((n for n in candidates if usable(n)), None)


def choose_binary_target(names: Sequence[str], distinct: Callable[[str], int]) -> str:
    """Exact well-known name, else the first two-valued column, else the last."""
    known = [c for c in TARGET_CANDIDATES_EXACT if c in names]
    return known[0] if known else next((n for n in names if distinct(n) == 2), names[-1])


def leaky_names(names: Sequence[str], target: str, profile: AuditProfile = AUDIT) -> list[str]:
    """Columns whose name suggests the outcome, an identifier or free text."""
    fragments = list(profile.name_leaks)
    if profile.ban_by_target:
        upper = target.upper()
        if "HEART" in upper:
            fragments += BANNED_FOR_HEART
        elif "DIED" in upper or "DEATH" in upper:
            fragments += BANNED_FOR_DEATH
    return [n for n in names if n != target and any(f in n.upper() for f in fragments)]


def first_values(df: DataFrame, column: str, n: int = 5) -> list:
    """The first ``n`` distinct values in row order."""
    first = df.select(col(column).alias("v"), F.monotonically_increasing_id().alias("i")).where("v is not null")
    return [r["v"] for r in first.groupBy("v").agg(F.min("i").alias("i")).orderBy("i").limit(n).collect()]


def is_survey_coded(values: Sequence) -> bool:
    """Are there values, and all of them survey codes?"""
    return bool(values) and all(not isinstance(v, (str, bool)) and v in SURVEY_CODES for v in values)


def has_survey_codes(df: DataFrame, target: str) -> bool:
    """Decided on every value of the column: more values than codes cannot all be codes."""
    found = df.select(col(target).alias("v")).where("v is not null").distinct().limit(len(SURVEY_CODES) + 1).collect()
    return is_survey_coded([r["v"] for r in found])


def recode_yes_no(df: DataFrame, target: str) -> DataFrame:
    """1 = yes stays 1, 2 = no becomes 0; rows with other codes are left out."""
    t = col(target)
    return df.where(t.isin(1, 2)).withColumn(target, F.when(t == 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def choose_predictors(df: DataFrame, target: str, profile: AuditProfile = AUDIT, held: Sequence[str] = ()) -> list[str]:
    out = set(leaky_names(df.columns, target, profile)) | set(held) | {target}
    keep = [c for c in scalar_columns(df) if c not in out]
    if profile.max_string_distinct is not None:
        texts = [c for c in string_columns(df) if c in keep]
        counts = small_distinct_counts(df, texts, profile.max_string_distinct)
        keep = [c for c in keep if counts.get(c, 0) <= profile.max_string_distinct]
    if profile.max_any_distinct is not None:
        counts = small_distinct_counts(df, keep, profile.max_any_distinct)
        keep = [c for c in keep if counts[c] < profile.max_any_distinct]
    return keep


def analyse_structure(df: DataFrame, profile: AuditProfile = AUDIT, held: Sequence[str] = ()) -> Structure:
    """Clean names, repair and choose the target, choose predictors.

    ``held`` columns (row keys) are carried along untouched.
    """
    dropped: list[str] = []
    renamed: dict[str, str] = {}

    def names(frame: DataFrame) -> list[str]:
        return [c for c in frame.columns if c not in held]

    def drop(frame: DataFrame) -> DataFrame:
        gone = artifact_columns(names(frame), profile.artifact_names) if profile.drop_artifacts else []
        dropped.extend(gone)
        return frame.drop(*gone)

    def decode(frame: DataFrame) -> DataFrame:
        renamed.update(codebook_renames(names(frame)))
        return frame.withColumnsRenamed(renamed)

    df = drop(decode(df)) if profile.decode_before_drop else decode(drop(df))
    if profile.repair_sparse:
        df = repair_sparse_outcomes(df, held)
    comparable = scalar_columns(df)
    known: dict[str, int] = {}

    def distinct(name: str) -> int:
        if name not in known:
            found = small_distinct_counts(df, [name], profile.target_max_classes) if name in comparable else {}
            known[name] = found.get(name, 0)
        return known[name]

    target = choose_target(names(df), distinct, profile)
    if target is None:
        return Structure(df, None, [], dropped, renamed)
    if profile.survey_recode and has_survey_codes(df, target):
        df = recode_yes_no(df, target)
    return Structure(df, target, choose_predictors(df, target, profile, held), dropped, renamed)
