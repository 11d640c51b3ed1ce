"""Intermediate tables that are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir;
    only a local master may run without that setting."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="galvanite-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the
    lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(*tables: DataFrame, each: int = 1_000_000) -> int:
    """Partitions for a shuffle of these tables together, so that a task's
    rows stay as many however large the tables are; the session's number if
    that is more. Counts the rows: for tables that are scanned or ``kept``."""
    spark = tables[0].sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(t.count() for t in tables) // each))
