"""Audits of append-only event streams. Violations are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gaps(events: DataFrame, key: list[str], position: str, first: int = 1, order: list[str] | None = None) -> DataFrame:
    """Rows whose position isn't the count of rows up to them, in the order
    of the position, or of ``order`` where positions repeat."""
    order = Window.partitionBy(*key).orderBy(*(order or [position]))
    return events.withColumn("expected", (F.row_number().over(order) + (first - 1)).cast("long")).where(F.col(position) != F.col("expected"))


def moves(events: DataFrame, key: list[str], order: str, state: str) -> DataFrame:
    """Each event with the state before it (null for the first)."""
    before = Window.partitionBy(*key).orderBy(order)
    return events.withColumn("source", F.lag(state).over(before)).withColumn("target", F.col(state))


def falling(events: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before: lease generations never fall."""
    before = Window.partitionBy(*key).orderBy(order)
    return events.withColumn("previous", F.lag(value).over(before)).where(F.col(value) < F.col("previous"))


def changed(events: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys for which a value that must not change has several."""
    return events.groupBy(*key).agg(F.min(value).alias("least"), F.max(value).alias("most")).where("least <> most")


def bad_causes(events: DataFrame, *, event: str, cause: str, position: str, stream: str, correlation: str | None = None) -> DataFrame:
    """Events whose cause is missing, later, or of another stream (or
    correlation): one self equi-join on the cause."""
    wanted = list(dict.fromkeys([event, position, stream, *([correlation] if correlation else [])]))
    causes = events.select(*(F.col(c).alias(f"_{c}") for c in wanted))
    joined = events.where(F.col(cause).isNotNull()).join(causes, F.col(cause) == F.col(f"_{event}"), "left")
    problem = F.when(F.col(f"_{event}").isNull(), "missing_cause").when(~F.col(stream).eqNullSafe(F.col(f"_{stream}")), "other_stream").when(F.col(f"_{position}") >= F.col(position), "not_prior")
    if correlation:
        problem = problem.when(~F.col(correlation).eqNullSafe(F.col(f"_{correlation}")), "other_correlation")
    return joined.withColumn("problem", problem).where("problem is not null").drop(*(f"_{c}" for c in wanted))


def last_state(events: DataFrame, key: list[str], order: str, *values: str) -> DataFrame:
    """The values of each key's last event: one struct maximum, no window."""
    last = F.max(F.struct(F.col(order), *values)).alias("_last")
    return events.groupBy(*key).agg(F.count("*").alias("n_events"), last).select(*key, "n_events", F.col(f"_last.{order}").alias(order), *(F.col(f"_last.{v}").alias(v) for v in values))


def first_problem(*problems: DataFrame, key: str, position: str) -> DataFrame:
    """The first violation of each stream: by position, then by rank of rule
    (the order of the arguments). Each has (key, position, rule, detail)."""
    ranked = [p.select(key, F.col(position).cast("long").alias(position), "rule", "detail", F.lit(i).alias("rank")) for i, p in enumerate(problems)]
    every = ranked[0]
    for p in ranked[1:]:
        every = every.unionByName(p)
    least = F.min(F.struct(position, "rank", "rule", "detail")).alias("_p")
    return every.groupBy(key).agg(least).select(key, F.col(f"_p.{position}").alias(position), F.col("_p.rule").alias("rule"), F.col("_p.detail").alias("detail"))


def difference(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys on which two tables differ, null-safe: only_left, only_right or
    the names of the values that differ."""
    a = left.select(*key, *(F.col(v).alias(f"l_{v}") for v in values), F.lit(True).alias("_l"))
    b = right.select(*key, *(F.col(v).alias(f"r_{v}") for v in values), F.lit(True).alias("_r"))
    both = a.join(b, key, "full_outer")
    fields = F.array_compact(F.array(*(F.when(~F.col(f"l_{v}").eqNullSafe(F.col(f"r_{v}")), F.lit(v)) for v in values)))
    kind: Column = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.size(fields) > 0, F.array_join(fields, ","))
    return both.withColumn("difference", kind).where("difference is not null").drop("_l", "_r")
