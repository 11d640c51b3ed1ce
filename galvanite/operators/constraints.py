"""Table constraints as audits: one query of violations for each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shown(rule: str, key: list[str], rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key)).alias("subject"))


def check(rule: str, rows: DataFrame, key: list[str], condition: Column) -> DataFrame:
    """Rows for which the condition is false; unknown passes, as in SQL."""
    return _shown(rule, key, rows.where(~condition))


def unique(rule: str, rows: DataFrame, key: list[str], where: Column | None = None) -> DataFrame:
    """Keys with several rows; null keys don't count. ``where`` makes it partial."""
    chosen = rows if where is None else rows.where(where)
    return _shown(rule, key, chosen.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))


def foreign(rule: str, rows: DataFrame, key: list[str], target: DataFrame, target_key: list[str]) -> DataFrame:
    """Rows whose key, if whole, isn't in the target."""
    whole = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key)))
    known = target.select(*(F.col(t).alias(k) for k, t in zip(key, target_key, strict=True)))
    return _shown(rule, key, whole.join(known, key, "left_anti"))


def report(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)
