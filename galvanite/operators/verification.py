"""Verifying what was released: every rule's violations as rows.

A package or bundle is sound if ``campaign_problems`` or ``bundle_problems``
gives no row. Rules have the order of their checks, so the first one broken
is the least rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.operators import evidence, replay
from galvanite.operators.tables import parts_for

RULES = ("foreign_row", "event_stream", "projection", "relation_twice", "relation_to_itself", "relation_outside", "no_lineage_root", "metric_without_observation", "object")


def _rows(rule: str, rows: DataFrame, campaign: str | None, *subject: str) -> DataFrame:
    own = F.col(campaign).cast("string") if campaign else F.lit(None).cast("string")
    return rows.select(F.lit(RULES.index(rule)).alias("rank"), F.lit(rule).alias("rule"), own.alias("campaign_id"), F.concat_ws("|", *(F.col(c).cast("string") for c in subject)).alias("subject"))


def relation_problems(relations: DataFrame, universe: DataFrame) -> DataFrame:
    """Edges that occur twice, relate a record to itself or leave the
    universe (one column, id)."""
    key = ["subject_id", "predicate", "object_id"]
    twice = relations.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    ends = relations.select(*key, F.explode(F.array("subject_id", "object_id")).alias("id"))
    parts = parts_for(relations, relations, universe)
    outside = evidence.dangling(ends.repartition(parts, "id"), universe.repartition(parts, "id"), "id").select(*key).distinct()
    return reduce(DataFrame.unionByName, (_rows("relation_twice", twice, None, *key), _rows("relation_to_itself", relations.where("subject_id = object_id"), None, *key), _rows("relation_outside", outside, None, *key)))


def bundle_problems(observations: DataFrame, metrics: DataFrame, recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """(rank, rule, campaign_id, subject): observations without a lineage
    root, metrics without their observation and attempt, and objects whose
    presence, size or digest differ. ``observations`` has (campaign_id,
    observation_id, attempt_id, root), ``metrics`` (campaign_id, metric_id,
    observation_id, attempt_id); objects as in ``evidence.checksum_audit``."""
    pair = ["observation_id", "attempt_id"]
    parts = parts_for(metrics, observations)
    alone = metrics.repartition(parts, *pair).join(observations.select(*pair).repartition(parts, *pair), pair, "left_anti")
    return reduce(DataFrame.unionByName, (
        _rows("no_lineage_root", observations.where("root is null"), "campaign_id", *pair),
        _rows("metric_without_observation", alone, "campaign_id", "metric_id"),
        _rows("object", evidence.checksum_audit(recorded, observed), None, "path", "problem"),
    ))


def campaign_problems(events: DataFrame, packaged: dict[str, DataFrame], members: DataFrame, relations: DataFrame, universe: DataFrame, bundle: DataFrame) -> DataFrame:
    """All problems of released campaigns, first rule first: rows of another
    campaign (``members``: campaign_id, row_campaign_id, member), the first
    violation of each event stream, packaged projections that a replay
    doesn't give, relations, and what ``bundle_problems`` found."""
    foreign = members.where(~F.col("campaign_id").eqNullSafe(F.col("row_campaign_id")))
    drift = replay.compare_sections(replay.sections(events), packaged)
    return reduce(DataFrame.unionByName, (
        _rows("foreign_row", foreign, "campaign_id", "member"),
        _rows("event_stream", replay.first_violations(events), "campaign_id", "rule"),
        _rows("projection", drift, "campaign_id", "section", "subject", "difference"),
        relation_problems(relations, universe), bundle,
    ))


def restored(before: dict[str, DataFrame], after: dict[str, DataFrame], key: dict[str, list[str]]) -> DataFrame:
    """(name, problem, n): tables whose number of rows, or whose rows by key,
    a restore did not bring back. Rows are compared by a digest of all their
    columns, so one join by key settles each table."""
    parts = []
    for name, old in before.items():
        digest = lambda t, k=name: t.select(*key[k], F.xxhash64(*sorted(t.columns)).alias("_d"))
        both = digest(old).withColumnRenamed("_d", "_a").join(digest(after[name]).withColumnRenamed("_d", "_b"), key[name], "full_outer")
        problem = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
        parts.append(both.select(F.lit(name).alias("name"), problem.alias("problem")).where("problem is not null").groupBy("name", "problem").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)
