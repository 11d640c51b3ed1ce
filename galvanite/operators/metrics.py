"""Reducing sweeps to quality-gated metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SAMPLES = 50


def cathodic_extremum(points: DataFrame, key: str, *, row: str = "row_no", current: str = "current", potential: str = "potential", least: int = LEAST_SAMPLES) -> DataFrame:
    """The most negative current of each sweep, its potential and a verdict.

    Of equal currents the first row counts. Fewer than ``least`` samples
    reject the metric, its values are then null; a current that never goes
    below zero gives a warning. Rows without a current or potential are no
    samples. One aggregate of fixed size for each sweep, combined before the
    shuffle."""
    whole = F.col(current).isNotNull() & F.col(potential).isNotNull()
    lowest = F.min(F.when(whole, F.struct(F.col(current).alias("i"), F.col(row).alias("r"), F.col(potential).alias("e"))))
    found = points.groupBy(key).agg(F.count_if(whole).alias("n_samples"), lowest.alias("lowest"))
    status = F.when(F.col("n_samples") < least, "rejected").when(F.col("lowest.i") >= 0, "warning").otherwise("accepted")
    shown = lambda field: F.when(F.col("n_samples") >= least, F.col(f"lowest.{field}"))
    return found.select(key, "n_samples", status.alias("quality_status"), shown("i").alias("extremum_current"), shown("e").alias("extremum_potential"))


def metric_rows(metrics: DataFrame, key: str) -> DataFrame:
    """Two rows for each sweep (current and potential at the extremum);
    rejected ones stay, with a null value."""
    pair = F.inline(F.array(F.struct(F.lit("cathodic_extremum_current").alias("name"), F.col("extremum_current").alias("value"), F.lit("A").alias("unit")), F.struct(F.lit("cathodic_extremum_potential").alias("name"), F.col("extremum_potential").alias("value"), F.lit("V").alias("unit"))))
    return metrics.select(key, "quality_status", pair)
