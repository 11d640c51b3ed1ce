"""Closure of evidence: manifests, objects, lineage and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_set(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem): members that are missing or unexpected, once each. One
    aggregate over both tables reads each once, and a null is a member too."""
    both = declared.select(key, F.lit(True).alias("_d")).unionByName(found.select(key, F.lit(False).alias("_d")))
    sides = both.groupBy(key).agg(F.min("_d").alias("_all"), F.max("_d").alias("_any"))
    return sides.where("_all = _any").select(key, F.when(F.col("_all"), "missing").otherwise("unexpected").alias("problem"))


def multiset_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The keys that two tables don't hold equally often, with n_left and
    n_right: one counting aggregate over both, so nulls are keys too."""
    marked = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return marked.groupBy(*key).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right")).where("n_left <> n_right")


def checksum_audit(recorded: DataFrame, observed: DataFrame, key: str = "path") -> DataFrame:
    """Every recorded or observed object whose presence, size or SHA-256
    disagree. Both have (key, size, sha256); repeats count once."""
    a = recorded.select(key, F.col("size").alias("_size"), F.col("sha256").alias("_sha")).distinct()
    both = a.join(observed.select(key, "size", "sha256").distinct(), key, "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_sha").isNull(), "unexpected").when(F.col("size") != F.col("_size"), "size_mismatch").when(F.col("sha256") != F.col("_sha"), "checksum_mismatch")
    return both.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def dangling(references: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """References to what isn't in the universe."""
    return references.where(F.col(key).isNotNull()).join(universe.select(key).distinct(), key, "left_anti")


def referenced(objects: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Adds referenced: whether any table refers to the object. Each table's
    keys are made distinct first, then joined once."""
    named = [r.select(F.col(r.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct() for r in references]
    every = reduce(DataFrame.union, named).distinct().withColumn("referenced", F.lit(True))
    return objects.join(every, key, "left").withColumn("referenced", F.coalesce("referenced", F.lit(False)))


def unclosed(steps: DataFrame, sources: DataFrame, *, graph: str = "graph_id", ordinal: str = "ordinal") -> DataFrame:
    """Inputs of lineage steps that are neither a source nor the output of an
    earlier step of the graph. ``steps`` has inputs and outputs arrays,
    ``sources`` (graph, id)."""
    wanted = steps.select(graph, ordinal, F.explode("inputs").alias("id"))
    made = steps.select(graph, F.explode("outputs").alias("id"), F.col(ordinal).alias("_o")).groupBy(graph, "id").agg(F.min("_o").alias("made_at"))
    known = made.unionByName(sources.select(graph, "id", F.lit(-1).cast("long").alias("made_at"))).groupBy(graph, "id").agg(F.min("made_at").alias("made_at"))
    return wanted.join(known, [graph, "id"], "left").where(F.col("made_at").isNull() | (F.col("made_at") >= F.col(ordinal))).select(graph, ordinal, "id")


def missing_edges(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (subject, predicate, object) to add, so that each wanted one is there."""
    key = ["subject", "predicate", "object"]
    return wanted.select(*key).distinct().join(edges.select(*key), key, "left_anti")


def lineage_depth(steps: DataFrame, key: str, number: str, before: Column) -> DataFrame:
    """How many links lead from each record back without a break: each
    record's predecessor is ``before``; a run of present predecessors is one
    group of the difference between number and rank, so no recursion is needed."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(key).orderBy(number)
    broken = F.when(F.lag(number).over(order).eqNullSafe(before), 0).otherwise(1)
    runs = steps.withColumn("_broken", broken).withColumn("_run", F.sum("_broken").over(order)).drop("_broken")
    start = Window.partitionBy(key, "_run").orderBy(number)
    return runs.withColumn("depth", (F.row_number().over(start) - 1).cast("long")).drop("_run")
