"""Quality findings for one or many tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tabaudit.config import QualityRules
from tabaudit.operators import quality


def critique(tables: Mapping[str, DataFrame], rules: QualityRules = QualityRules()) -> DataFrame:
    """All findings of all tables as one table."""
    out = None
    for name, df in tables.items():
        part = quality.findings(df, name, rules)
        out = part if out is None else out.unionByName(part)
    return out
