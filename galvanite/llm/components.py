"""Connected components of an edge table, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.llm.common import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a long, b long): the
    smallest vertex it can reach.

    Each round ranks the vertices by a hash that is new in that round, names
    every vertex by the first of itself and its neighbours, relabels the edges
    by those names and drops loops and repeats. A vertex stays joined to its
    new name, as that edge is relabelled too, so the components are those of
    the input. As the ranking is random, only a share of the vertices (at most
    two thirds, expected) is anyone's first, whatever the shape of the graph:
    the rounds grow with the logarithm of the number of vertices, on long
    chains too. Rounds end when no edge is left; then the names of all rounds
    are composed, last first, so no round carries the whole table.

    Only aggregates and equi-joins are used: no vertex's neighbours are
    gathered, and a vertex with very many edges is pre-aggregated like any
    other. Edges with a null end and loops are ignored; an empty table gives
    none."""
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    rounds: list[DataFrame] = []
    used: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda v: F.struct(F.xxhash64(v, F.lit(len(rounds))).alias("h"), F.col(v).alias("m"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("n"))
        names = written(first.select("v", F.least("n", rank("v"))["m"].alias("m")), "names")
        rounds.append(names)
        of_a, of_b = (names.select(F.col("v").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")
        used += [edges, names]
        edges = edges.join(of_a, "a").join(of_b, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        edges = written(edges, "edges")
    if not rounds:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    labels = rounds.pop()
    while rounds:
        after = labels.select(F.col("v").alias("m"), F.col("m").alias("later"))
        labels = rounds.pop().join(after, "m", "left").select("v", F.coalesce("later", "m").alias("m"))
    labels = written(labels, "labels")
    removed(*used)
    least = labels.groupBy("m").agg(F.min("v").alias("component"))
    return written(labels.join(least, "m").select("v", "component"), "components")
