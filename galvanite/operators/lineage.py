"""Lineage over any graph of records: what each record comes from, how deep it
lies, and what comes from itself.

Edges are (child, parent). Paths are doubled: a round joins paths of up to n
edges to paths of up to n edges, so the rounds grow with the logarithm of the
depth. Rows are pairs of a record and something it comes from; ``depths``,
which needs no distances, holds each record's ancestors as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galvanite.operators.tables import kept


def _doubled(pairs: DataFrame) -> DataFrame:
    """The closure of edges (record, ancestor, n = 1), with the least n. When
    all paths of up to n edges are known, those of up to 2n are one of just n
    edges and a further one: no others are joined."""
    pairs, reached = kept(pairs), 1
    while True:
        further = pairs.select(F.col("record").alias("ancestor"), F.col("ancestor").alias("_beyond"), F.col("n").alias("_n"))
        longer = pairs.where(F.col("n") == reached).join(further, "ancestor").select("record", F.col("_beyond").alias("ancestor"), (F.col("n") + F.col("_n")).alias("n"))
        pairs = kept(pairs.unionByName(longer).groupBy("record", "ancestor").agg(F.min("n").alias("n")))
        reached *= 2
        if pairs.where(F.col("n") == reached).isEmpty():
            return pairs


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(record, ancestor, distance): everything that a record comes from, by
    the fewest edges. On a cycle a record is an ancestor of its own. Edges
    with a null end are not read; repeated ones count once."""
    return _doubled(_edges(edges, child, parent)).withColumnRenamed("n", "distance")


def _edges(edges: DataFrame, child: str, parent: str) -> DataFrame:
    ends = edges.select(F.col(child).alias("record"), F.col(parent).alias("ancestor"))
    return ends.where("record is not null and ancestor is not null").distinct().withColumn("n", F.lit(1).cast("long"))


def _joined(sets: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(sets)))


def reach(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(record, ancestors): what each record comes from, as one array without
    repeats; records without parents have no row. On a cycle a record is an
    ancestor of its own.

    Doubled as in ``ancestors``: ``_at`` are the ancestors at just n edges,
    ``_below`` the nearer ones, and a round joins a record's ``_at`` to what
    these have. A record's ancestors lie in one row, 8 bytes for each."""
    ends = _edges(edges, child, parent)
    none = F.array().cast(T.ArrayType(ends.schema["ancestor"].dataType))
    sets = kept(ends.groupBy("record").agg(none.alias("_below"), F.collect_list("ancestor").alias("_at")))
    while not sets.where(F.size("_at") > 0).isEmpty():
        steps = sets.where(F.size("_at") > 0).select("record", F.explode("_at").alias("_mid"))
        further = sets.select(F.col("record").alias("_mid"), F.col("_below").alias("_b"), F.col("_at").alias("_a"))
        found = steps.join(further, "_mid").groupBy("record").agg(_joined(F.col("_b")).alias("_b"), _joined(F.col("_a")).alias("_a"))
        both = sets.join(found, "record", "left").withColumns({"_b": F.coalesce("_b", none), "_a": F.coalesce("_a", none)})
        nearer = both.withColumn("_below", F.array_distinct(F.concat("_below", "_at", "_b")))
        sets = kept(nearer.select("record", "_below", F.array_except("_a", "_below").alias("_at")))
    return sets.select("record", F.col("_below").alias("ancestors"))


def _longest(edges: DataFrame) -> DataFrame:
    """(record, depth) of the records of a graph (record, ancestor) without
    cycles that have parents: the most edges to an end. ``depth`` counts up
    to n - 1 edges, ``_at`` is what a walk of just n edges comes to: a record
    with such a walk is n deeper than the deepest of these."""
    sets, n = kept(edges.groupBy("record").agg(F.lit(0).cast("long").alias("depth"), F.collect_list("ancestor").alias("_at"))), 1
    none = F.array().cast(sets.schema["_at"].dataType)
    while not sets.where(F.size("_at") > 0).isEmpty():
        steps = sets.where(F.size("_at") > 0).select("record", F.explode("_at").alias("_mid"))
        further = sets.select(F.col("record").alias("_mid"), F.col("depth").alias("_d"), F.col("_at").alias("_a"))
        # an end has no row of its own: its depth is 0
        found = steps.join(further, "_mid", "left").groupBy("record").agg((F.coalesce(F.max("_d"), F.lit(0)) + n).alias("_d"), _joined(F.col("_a")).alias("_a"))
        both = sets.drop("_at").join(found, "record", "left")
        sets = kept(both.select("record", F.coalesce("_d", "depth").alias("depth"), F.coalesce("_a", none).alias("_at")))
        n *= 2
    return sets.select("record", "depth")


def depths(edges: DataFrame, records: DataFrame, *, key: str = "record", child: str = "child", parent: str = "parent") -> DataFrame:
    """(record, depth, n_ancestors, problem) of each record of ``records``:
    the most edges to a record without parents, and how many it comes from. A
    record on a cycle has problem ``cycle``, one that comes from such a
    record ``comes_from_cycle``; both have no depth. A record without edges
    has depth 0; parents that are no records count as ends."""
    known = reach(edges, child, parent)
    counts = kept(known.select("record", F.size("ancestors").cast("long").alias("n_ancestors"), F.array_contains("ancestors", F.col("record")).alias("_on")))
    on = counts.where("_on").select("record")
    behind = kept(known.select("record", F.explode("ancestors").alias("_a")).join(on.withColumnRenamed("record", "_a"), "_a", "left_semi").select("record").distinct())
    longest = _longest(_edges(edges, child, parent).join(behind, "record", "left_anti"))
    named = records.select(F.col(key).alias("record")).where("record is not null").distinct()
    marks = counts.join(behind.withColumn("_behind", F.lit(True)), "record", "left").select("record", "n_ancestors", F.when(F.col("_on"), "cycle").when(F.col("_behind"), "comes_from_cycle").alias("problem"))
    joined = named.join(longest, "record", "left").join(marks, "record", "left")
    return joined.select("record", F.when(F.col("problem").isNull(), F.coalesce("depth", F.lit(0))).cast("long").alias("depth"), F.coalesce("n_ancestors", F.lit(0)).cast("long").alias("n_ancestors"), "problem")


def open_records(edges: DataFrame, sources: DataFrame, outputs: DataFrame, *, child: str = "child", parent: str = "parent") -> DataFrame:
    """(record, missing): records that come from something that is neither a
    source nor an output (one column, id, each), at any distance."""
    known = sources.select("id").unionByName(outputs.select("id")).distinct()
    lost = ancestors(edges, child, parent).join(known.withColumnRenamed("id", "ancestor"), "ancestor", "left_anti")
    return lost.select("record", F.col("ancestor").alias("missing"))
