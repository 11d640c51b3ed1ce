"""Campaign views: status, measurements, evidence rows, fault summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes that count as a failure without a recorded one.
FAILED = ("corrupted", "lease_lost", "timed_out")


def tally(rows: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """(keys, n): how many rows have each combination."""
    return (rows if where is None else rows.where(where)).groupBy(*keys).agg(F.count("*").alias("n"))


def counts(rows: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """(key, n, ...): rows of each key, and how many meet each condition."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def excess(rows: DataFrame, key: str, a: Column, b: Column, valid: Column) -> DataFrame:
    """(key, n, excess, all_valid): by how much a exceeds b, summed over the
    rows where it does, and whether every row is valid."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.greatest(a - b, F.lit(0))).cast("bigint").alias("excess"), F.bool_and(valid).alias("all_valid"))


def branches(**parts: DataFrame) -> DataFrame:
    """Tables one after the other: kind and branch (its rank) tell which a row
    is from; a column that a branch lacks is null there."""
    named = [p.withColumns({"kind": F.lit(name), "branch": F.lit(i)}) for i, (name, p) in enumerate(parts.items())]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named)


def status_view(campaigns: DataFrame, items: DataFrame, outcomes: DataFrame, key: str, item: str) -> DataFrame:
    """Each campaign with its work_items, succeeded, failed and attempts.

    ``items`` has (key, item), ``outcomes`` (item, status); both are reduced
    to one row for each campaign before they meet it."""
    of_item = outcomes.groupBy(item).agg(F.count_if(F.col("status") == "succeeded").alias("s"), F.count_if(F.col("status") == "failed_terminal").alias("f"), F.count("*").alias("a"))
    sums = items.select(key, item).join(of_item, item, "left").groupBy(key).agg(F.count("*").alias("work_items"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("s", "succeeded"), ("f", "failed"), ("a", "attempts"))))
    names = ("work_items", "succeeded", "failed", "attempts")
    return campaigns.join(sums, key, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def measurements(outcomes: DataFrame, observations: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """One row of counts for each campaign of ``outcomes`` (key, status,
    failure_code), with its sorted failure codes. ``observations`` has (key,
    status), ``staged`` (key): what was stored, used or not."""
    n = lambda status: F.count_if(F.col("status") == status)
    ends = outcomes.groupBy(key).agg(F.count("*").alias("attempts_created"), n("succeeded").alias("accepted_outcomes"), n("duplicate_suppressed").alias("duplicate_suppressions"), F.array_sort(F.collect_list("failure_code")).alias("failure_codes"))
    seen = observations.groupBy(key).agg(n("received").alias("observations_received"), n("accepted").alias("observations_accepted"), n("corrupted").alias("corrupted_receipts"))
    out = ends.join(seen, key, "left").join(staged.groupBy(key).agg(F.count("*").alias("observations_staged")), key, "left")
    return out.na.fill(0, ["observations_received", "observations_accepted", "corrupted_receipts", "observations_staged"])


def failures_and_recoveries(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """Failed attempts, then recovery events: kind, branch (their order),
    subject, status and failure. ``attempts`` has (attempt_id, status,
    failure), ``events`` (event_id, event_type, last_failure)."""
    failed = attempts.where(F.col("failure").isNotNull() | F.col("status").isin(*FAILED)).select(F.lit("failure").alias("kind"), F.lit(0).alias("branch"), F.col("attempt_id").cast("string").alias("subject"), "status", "failure")
    recovered = (F.col("event_type") == "job.lease_expired") | ((F.col("event_type") == "job.available") & F.col("last_failure").isNotNull())
    back = events.where(recovered).select(F.lit("recovery").alias("kind"), F.lit(1).alias("branch"), F.col("event_id").cast("string").alias("subject"), F.col("event_type").alias("status"), F.col("last_failure").alias("failure"))
    return failed.unionByName(back)


def attempt_evidence(attempts: DataFrame, observations: DataFrame, metrics: DataFrame, key: list[str]) -> DataFrame:
    """Each attempt with its observation, if any, and its metrics, a sorted
    list of struct<name, value>, if any."""
    listed = metrics.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("metrics"))
    return attempts.join(observations, key, "left").join(listed, key, "left").withColumn("metrics", F.coalesce("metrics", F.array().cast(listed.schema["metrics"].dataType)))


def object_problems(observations: DataFrame, objects: DataFrame, key: list[str], uri: str = "object_uri") -> DataFrame:
    """(key, problem): observations whose stored object isn't recorded, is
    recorded several times, or differs in digest, size, place or state.
    ``objects`` has (object_uri, bucket, object_key, sha256, byte_size, state)."""
    names = ("bucket", "object_key", "sha256", "byte_size", "state")
    kept = objects.select(F.col(uri).alias("_uri"), *(F.col(n).alias(f"_{n}") for n in names))
    both = observations.join(kept, F.col(uri) == F.col("_uri"), "left")
    same = (F.col("sha256") == F.col("_sha256")) & (F.col("byte_size") == F.col("_byte_size")) & (F.col(uri) == F.concat(F.lit("s3://"), F.col("_bucket"), F.lit("/"), F.col("_object_key"))) & (F.col("_state") == "committed")
    problem = F.when(F.col("_n") > 1, "duplicate_inventory").when(F.col("_none"), "no_metadata").when(~F.col("_same"), "inconsistent")
    sums = both.groupBy(*key).agg(F.count("*").alias("_n"), F.bool_or(reduce(lambda a, b: a | b, (F.col(f"_{n}").isNull() for n in names))).alias("_none"), F.bool_and(F.coalesce(same, F.lit(False))).alias("_same"))
    return sums.withColumn("problem", problem).where("problem is not null").select(*key, "problem")


def relation_rows(relations: DataFrame, universe: DataFrame, derived: DataFrame) -> DataFrame:
    """Relations with both ends in the universe (one column, id), and a
    derived_from edge, made up, for each of ``derived`` (subject_id,
    object_id) that has none."""
    ids = universe.select("id").distinct()
    inside = relations.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi").select("subject_id", "predicate", "object_id", F.lit(False).alias("made_up"))
    edges = derived.select("subject_id", F.lit("derived_from").alias("predicate"), "object_id").distinct()
    return inside.unionByName(edges.join(inside, ["subject_id", "predicate", "object_id"], "left_anti").withColumn("made_up", F.lit(True)))


def roots(observations: DataFrame, source: Column, synthetic: Column) -> DataFrame:
    """(digest, root): the distinct lineage roots, what was observed before
    what was generated; null roots have a null digest, for an audit to see."""
    return observations.select(F.coalesce(source, synthetic).alias("root")).distinct().select(F.sha2("root", 256).alias("digest"), "root")


def fault_summary(rows: DataFrame) -> DataFrame:
    """One row over measurement rows: what was lost, doubled, overspent or
    not verified, and whether the release is met. Adverse rows all count."""
    more = lambda a, b: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0)).cast("bigint")
    out = rows.agg(
        F.count("*").alias("campaigns_executed"),
        more("accepted_outcomes", "observations_accepted").alias("lost_accepted_observations"),
        more("observations_accepted", "accepted_outcomes").alias("unintended_duplicate_acceptances"),
        F.count_if(F.col("budget_committed") > F.col("hard_budget")).alias("hard_budget_overspends"),
        F.count_if(~F.col("replay_equal")).alias("projection_mismatches"),
        F.count_if(~F.col("package_verified")).alias("failed_package_verifications"),
        F.coalesce(F.sum("corrupted_receipts"), F.lit(0)).cast("bigint").alias("corrupted_receipts_retained"),
        F.coalesce(F.sum("duplicate_suppressions"), F.lit(0)).cast("bigint").alias("duplicate_suppressions"),
    )
    bad = ("lost_accepted_observations", "unintended_duplicate_acceptances", "hard_budget_overspends", "projection_mismatches", "failed_package_verifications")
    return out.withColumn("acceptance_met", reduce(lambda a, b: a & b, (F.col(c) == 0 for c in bad)))


def impossible_measurements(rows: DataFrame, key: str) -> DataFrame:
    """(key, problem): measurement rows that can't be: times out of order,
    more objects verified than referred to, no budget."""
    at = ("process_started_at", "checkpoint_reached_at", "process_killed_at", "restart_completed_at")
    ordered = reduce(lambda a, b: a & b, (F.col(x) <= F.col(y) for x, y in zip(at, at[1:], strict=False)))
    problem = F.when(~F.coalesce(ordered, F.lit(False)), "times_out_of_order").when(F.col("objects_verified") > F.col("objects_referenced"), "verified_beyond_referenced").when(F.col("hard_budget") <= 0, "no_budget")
    return rows.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table: what a restore must have again."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in sorted(tables.items())))


def wide_cells(rows: DataFrame) -> DataFrame:
    """Rows for a delimited file: nested cells as JSON text."""
    nested = [f.name for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct")]
    return rows.withColumns({c: F.to_json(c) for c in nested})
