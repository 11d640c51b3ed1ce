"""Job queues as analysis over recorded state, at a stated time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def next_claimable(jobs: DataFrame, key: str, order: list[str], ready: Column) -> DataFrame:
    """The first ready job of each queue: one struct minimum, no sort."""
    rest = [c for c in jobs.columns if c not in (key, *order)]
    least = F.min(F.struct(*order, *rest)).alias("_job")
    return jobs.where(ready).groupBy(key).agg(least).select(key, "_job.*")


def accept_once(outcomes: DataFrame, key: list[str], order: list[str], success: Column | None = None) -> DataFrame:
    """The first success of each work item is accepted, later ones are
    suppressed duplicates; what did not succeed keeps no acceptance."""
    success = F.lit(True) if success is None else success
    rank = F.row_number().over(Window.partitionBy(*key, success).orderBy(*order))
    return outcomes.withColumn("acceptance", F.when(~success, F.lit(None)).when(rank == 1, "accepted").otherwise("duplicate_suppressed"))


def enqueue_once(requests: DataFrame, key: str, order: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(the first request of each instruction key, keys asked for several targets)."""
    rest = [c for c in requests.columns if c not in (key, order)]
    first = requests.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r")).select(key, "_r.*")
    conflicts = requests.groupBy(key).agg(F.count_distinct(target).alias("targets")).where("targets > 1")
    return first, conflicts


def expired_leases(jobs: DataFrame, as_of: Column) -> DataFrame:
    """What recovery does to jobs whose lease is over: a new generation, and
    back to the queue or, when attempts are spent, failed with its item
    quarantined."""
    lost = jobs.where(F.col("state").isin("leased", "running") & (F.col("lease_expires_at") <= as_of))
    spent = F.col("attempt_count") >= F.col("max_attempts")
    return lost.select("job_id", "work_item_id", (F.col("lease_generation") + 1).alias("lease_generation"), F.when(spent, "failed_terminal").otherwise("available").alias("state"), F.when(spent, F.lit("retry_cap_reached:lease_lost")).alias("quarantine_reason"))


def abandoned_attempts(attempts: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Open attempts of jobs whose lease is over end as lease_lost; their
    reservation is released if the adapter never started, else consumed."""
    over = jobs.where(F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= as_of)).select("job_id", "work_item_id")
    open_ = attempts.where(F.col("state").isin("leased", "running"))
    return open_.join(over, ["job_id", "work_item_id"]).select("attempt_id", "job_id", F.lit("lease_lost").alias("state"), F.when(F.col("adapter_started_at").isNull(), "released").otherwise("consumed").alias("settlement"))


def live(jobs: DataFrame, token: Column, generation: Column, as_of: Column) -> DataFrame:
    """Jobs whose lease a holder still has: token, generation and time agree."""
    return jobs.where((F.col("lease_token") == token) & (F.col("lease_generation") == generation) & (F.col("lease_expires_at") > as_of) & F.col("state").isin("leased", "running"))


def replayed_commands(commands: DataFrame, key: list[str], order: str, digest: str) -> DataFrame:
    """Each command after the first of its key: a replay if the request is
    the same, else a conflict."""
    window = Window.partitionBy(*key).orderBy(order)
    first = F.first(digest).over(window)
    return commands.withColumn("_n", F.row_number().over(window)).withColumn("outcome", F.when(F.col("_n") == 1, "stored").when(F.col(digest) == first, "replayed").otherwise("conflict")).drop("_n")


def controlled(commands: DataFrame) -> DataFrame:
    """What a pause, resume or cancel command does: ``commands`` has action,
    state (the campaign's, null if there is none), version (its last
    sequence) and expected_version. Adds outcome (the new state or an error
    code) and new_version."""
    from galvanite.functions.lifecycle import TRANSITIONS

    target = F.when(F.col("action") == "pause", "paused").when(F.col("action") == "resume", "active").when(F.col("action") == "cancel", "cancelled")
    legal = F.concat(F.col("state"), F.lit(" to "), target).isin(*(f"{s} to {t}" for s, ts in TRANSITIONS["campaign"].items() for t in ts))
    error = F.when(F.col("state").isNull(), "campaign_not_found").when(target.isNull(), "unknown_action").when(F.col("version") != F.col("expected_version"), "expected_version_mismatch").when(~legal, "illegal_transition")
    return commands.withColumn("outcome", F.coalesce(error, target)).withColumn("new_version", F.when(error.isNull(), F.col("version") + 1))


def cancelled_with_campaign(jobs: DataFrame, campaigns: DataFrame, key: str) -> DataFrame:
    """Available or waiting jobs of cancelled campaigns, as they end."""
    over = campaigns.where("state = 'cancelled'").select(key)
    return jobs.where(F.col("state").isin("available", "retry_scheduled")).join(over, key, "left_semi").withColumn("state", F.lit("cancelled"))


def source_verdicts(pending: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, state, reason) of reserved sources: committed if what is stored
    has the digest and size that were declared, else quarantined."""
    found = observed.select(key, F.col("sha256").alias("_sha"), F.col("byte_size").alias("_size"))
    both = pending.join(found, key, "left")
    reason = F.when(F.col("_sha").isNull(), "object_missing").when((F.col("_sha") != F.col("sha256")) | (F.col("_size") != F.col("byte_size")), "object_readback_mismatch")
    return both.select(key, F.when(reason.isNull(), "committed").otherwise("quarantined").alias("state"), reason.alias("reason"))


def reconciled(jobs: DataFrame, attempts: DataFrame, objects: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """One reconciliation pass: leases that are over are reclaimed, then the
    attempts that they leave are closed, then every object is judged with
    what those closures made known. ``objects`` has object_uri, attempt_id,
    exists, state, recorded, observed, accepted, outcome."""
    from galvanite.functions.lifecycle import object_verdict

    reclaimed = expired_leases(jobs, as_of)
    closed = abandoned_attempts(attempts, jobs, as_of)
    known = objects.join(closed.select("attempt_id", F.col("state").alias("_closed")), "attempt_id", "left")
    outcome = F.coalesce("outcome", "_closed")
    verdict = object_verdict(F.col("exists"), F.col("state"), F.col("recorded"), F.col("observed"), F.col("accepted"), outcome)
    judged = known.select("object_uri", verdict.alias("v")).select("object_uri", "v.verdict", "v.reason")
    return {"reclaimed": reclaimed, "closed": closed, "objects": judged}


def fault_plan(points: list[str], campaigns: int, seed: int) -> list[str]:
    """Each fault point equally often, in an order that the seed fixes."""
    import random

    if campaigns < len(points):
        raise ValueError("every fault point must occur")
    plan = [points[i % len(points)] for i in range(campaigns)]
    random.Random(seed).shuffle(plan)
    return plan
