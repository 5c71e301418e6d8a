"""All registered queries with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("descriptive", "judgement", "charts", "shaping", "linking", "scoring")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        part = getattr(import_module(f"tabaudit.queries.{module}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["calibrated_audit"](spark, sf_dir)
