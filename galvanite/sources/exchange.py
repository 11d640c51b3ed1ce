"""Wide exchange tables: one column for each series, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(long: DataFrame, key: list[str], fields: list[str], *, field: str = "field", value: str = "value") -> DataFrame:
    """One row for each key; cells keep their exact text."""
    return long.groupBy(*key).pivot(field, fields).agg(F.first(value))


def from_wide(wide: DataFrame, key: list[str], fields: list[str], *, field: str = "field", value: str = "value") -> DataFrame:
    return wide.select(*key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(key, fields, field, value)


def wide_counts(long: DataFrame, key: list[str], fields: list[str], *, field: str = "field") -> DataFrame:
    """One row for each key with the number of its rows for each field."""
    return long.groupBy(*key).pivot(field, fields).agg(F.count(F.lit(1))).na.fill(0)
