"""Ordinals of streams of any length.

A window over one key is one task. Here rows are dealt to ranges of (key,
order) of about equal size, counted there, and start from what the ranges
before hold of their key. A range's border cuts at most one key, so what is
sent to all tasks has no more rows than there are ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galvanite.operators.tables import kept


def ranged(rows: DataFrame, key: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with ``_range``, which grows with (key, order). Rows that are
    equal in both share one; ``order`` should tell a key's rows apart."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(ranges, *key, *order).withColumn("_range", F.spark_partition_id()))


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str], *, name: str = "ordinal", previous: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """The rows with ``name``, their number within their key from 1, and for
    each column c of ``previous`` previous_c, its value in the row before
    (null in a key's first row). Equal to row_number and lag over one window
    of the key, but no task has more than a range."""
    key, order = list(key), list(order)
    spread = ranged(rows, key, order, ranges)
    own = Window.partitionBy("_range", *key).orderBy(*order)
    local = spread.withColumn("_n", F.row_number().over(own).cast("long"))
    for c in previous:
        local = local.withColumn(f"_before_{c}", F.struct(F.lag(c).over(own).alias("v")))
    last = F.max_by(F.struct(*(F.col(c).alias(f"l_{c}") for c in previous), F.lit(1).alias("_")), F.struct(*order))
    parts = spread.groupBy("_range", *key).agg(F.count("*").alias("_count"), last.alias("_last"))
    # a key that lies in one range needs nothing from others: only those that a border cuts, at most two for each range, are carried on
    edge = Window.partitionBy(*key)
    cut = parts.withColumn("_ranges", F.count("*").over(edge)).where("_ranges > 1")
    up_to = edge.orderBy("_range")
    carried = cut.select("_range", *key, (F.sum("_count").over(up_to) - F.col("_count")).alias("_start"), F.lag("_last").over(up_to).alias("_edge")).where("_start > 0")
    carried = carried.select("_range", *(F.col(k).alias(f"_k_{k}") for k in key), "_start", "_edge")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.withColumnRenamed("_range", "_r").join(F.broadcast(carried), (F.col("_r") == F.col("_range")) & same, "left")
    out = joined.withColumn(name, F.col("_n") + F.coalesce("_start", F.lit(0)))
    for c in previous:
        out = out.withColumn(f"previous_{c}", F.when(F.col("_n") > 1, F.col(f"_before_{c}.v")).otherwise(F.col(f"_edge.l_{c}")))
    return out.select(*rows.columns, name, *(f"previous_{c}" for c in previous))


def position_gaps(rows: DataFrame, key: Sequence[str], position: str, tie: Sequence[str] = (), *, ranges: int | None = None) -> DataFrame:
    """Rows whose position isn't their number in their stream, with
    ``expected``; as ``streams.gaps``, for streams of any length."""
    found = numbered(rows, key, [position, *tie], name="expected", ranges=ranges)
    return found.where(~F.col(position).eqNullSafe(F.col("expected")))


#: The orders in which reports list their rows.
FINDINGS, LEDGER, PENDING = ("severity", "field_name"), ("recorded_at", "entry_id"), ("created_at", "artifact_id")
