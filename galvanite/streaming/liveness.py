"""Liveness from heartbeats, in batch and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def liveness(beats: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Runs of heartbeats less than ``gap`` apart: (key, started, lapsed,
    n_beats). On a stream give the frame a watermark first; a run is then
    emitted once it can't grow."""
    out = beats.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_beats"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("lapsed"), "n_beats")


def split_late(rows: DataFrame, time: str, watermark: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) against a stated watermark time: late results go to a
    sink of their own and are kept as received, never accepted."""
    limit = F.lit(watermark).cast("timestamp")
    return rows.where(F.col(time) >= limit), rows.where(F.col(time) < limit)
