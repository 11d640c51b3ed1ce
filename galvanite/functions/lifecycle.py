"""State machines, retry rules and object verdicts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Machine -> state -> states that may follow. Other states are final.
TRANSITIONS: Mapping[str, Mapping[str, tuple[str, ...]]] = {
    "campaign": {
        "draft": ("ready", "cancelled", "failed"),
        "ready": ("active", "cancelled", "failed"),
        "active": ("paused", "completed", "budget_exhausted", "cancelled", "failed"),
        "paused": ("active", "completed", "budget_exhausted", "cancelled", "failed"),
    },
    "work_item": {
        "proposed": ("validated", "rejected"),
        "validated": ("queued", "rejected"),
        "queued": ("accepted", "quarantined", "rejected", "cancelled"),
        "quarantined": ("queued", "rejected", "cancelled"),
    },
    "attempt": {
        "pending": ("leased", "cancelled"),
        "leased": ("running", "lease_lost", "cancelled"),
        "running": ("succeeded", "timed_out", "failed_retryable", "failed_terminal", "corrupted", "lease_lost", "duplicate_suppressed", "cancelled"),
    },
    "job": {
        "available": ("leased", "cancelled"),
        "leased": ("running", "available", "failed_terminal", "cancelled"),
        "running": ("succeeded", "retry_scheduled", "failed_terminal", "timed_out", "available", "cancelled"),
        "retry_scheduled": ("available", "cancelled"),
    },
}
#: Failure codes that may be tried again.
RETRYABLE = ("adapter_transient", "database_conflict", "lease_lost", "object_store_unavailable", "outcome_write_failed", "storage_unavailable", "timeout", "transport_failure")


def transition_table(spark: SparkSession) -> DataFrame:
    """(machine, source, target), a few dozen rows."""
    rows = [(m, s, t) for m, states in TRANSITIONS.items() for s, targets in states.items() for t in targets]
    return spark.createDataFrame(rows, "machine string, source string, target string")


def terminal_states(transitions: DataFrame) -> DataFrame:
    """(machine, state): targets from which nothing follows."""
    left = transitions.select("machine", F.col("source").alias("state")).distinct()
    return transitions.select("machine", F.col("target").alias("state")).distinct().join(left, ["machine", "state"], "left_anti")


def illegal(moves: DataFrame, transitions: DataFrame) -> DataFrame:
    """Rows of ``moves`` (machine, source, target, ...) that no rule allows."""
    return moves.join(F.broadcast(transitions), ["machine", "source", "target"], "left_anti")


def retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE)


def backoff_seconds(failures: Column, base: int = 2, most: int = 300) -> Column:
    """base doubled for each failure after the first, at most ``most``; integers."""
    doubled = base * F.pow(F.lit(2.0), F.greatest(failures, F.lit(1)) - 1)
    return F.least(doubled, F.lit(float(most))).cast("long")


def route_failure(state: Column, attempts: Column, most: Column, code: Column) -> Column:
    """What becomes of a job after a failure, first rule first: its campaign
    is over, its code is final, its attempts are spent, else it waits."""
    return (
        F.when(state.isin("cancelled", "budget_exhausted"), F.lit("cancelled"))
        .when(~retryable(code), F.lit("failed_terminal"))
        .when(attempts >= most, F.lit("failed_terminal"))
        .otherwise(F.lit("available"))
    )


def object_verdict(exists: Column, state: Column, recorded: Column, observed: Column, accepted: Column, outcome: Column) -> Column:
    """struct<verdict, reason> of a stored object, first rule first."""
    say = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when(~exists & (state == "committed"), say("missing", "recorded as committed"))
        .when(~exists, say("missing", "staged, never landed"))
        .when(recorded.isNotNull() & observed.isNotNull() & (recorded != observed), say("quarantined", "checksum differs from the record"))
        .when(accepted, say("accepted_evidence", "accepted evidence refers to it"))
        .when(outcome == "duplicate_suppressed", say("diagnostic_duplicate", "its attempt was a suppressed duplicate"))
        .when(outcome.isNull() & (state == "pending"), say("diagnostic_orphan", "never committed"))
        .otherwise(say("diagnostic_orphan", F.concat(F.lit("its attempt ended as "), F.coalesce(outcome, F.lit("unfinished")))))
    )
