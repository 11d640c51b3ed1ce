"""Order checks of series: time steps, constant intervals, lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def steps(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with step, its value less the one before (null for the first)."""
    return rows.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))


def not_increasing(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    return steps(rows, key, order, value).where("step <= 0")


def off_interval(rows: DataFrame, key: list[str], order: list[str], value: str, interval: Column) -> DataFrame:
    """Rows whose step isn't exactly the interval."""
    return steps(rows, key, order, value).where(F.col("step") != interval)


def lateness(rows: DataFrame, key: list[str], order: str, time: str, allowed: str) -> DataFrame:
    """late: whether the time lies more than ``allowed`` before the greatest
    time seen earlier. Late rows are marked, never dropped."""
    seen = F.max(time).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("late", F.coalesce(F.col(time) < seen - F.expr(allowed), F.lit(False)))
