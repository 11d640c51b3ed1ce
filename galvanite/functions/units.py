"""Exact unit conversion of decimal text.

A value keeps its source text, because trailing zeros are part of its
identity; the decimal beside it is for arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (source unit, target unit, factor). No other pair converts.
FACTORS = (
    ("V", "V", "1"),
    ("V vs. Ref.", "V", "1"),
    ("mV", "V", "0.001"),
    ("A", "A", "1"),
    ("mA", "A", "0.001"),
    ("uA", "A", "0.000001"),
    ("µA", "A", "0.000001"),
    ("nA", "A", "0.000000001"),
    ("A/m^2", "A/m^2", "1"),
    ("A/cm^2", "A/m^2", "10000"),
    ("mA/cm^2", "A/m^2", "10"),
    ("uA/cm^2", "A/m^2", "0.01"),
    ("µA/cm^2", "A/m^2", "0.01"),
    ("s", "s", "1"),
    ("ms", "s", "0.001"),
    ("min", "s", "60"),
    ("1", "1", "1"),
    ("#", "1", "1"),
)
FACTOR = {(source, target): Decimal(factor) for source, target, factor in FACTORS}


def factor_table(spark: SparkSession) -> DataFrame:
    """(source_unit, target_unit, factor), 18 rows: always small enough to broadcast."""
    return spark.createDataFrame([(s, t, Decimal(f)) for s, t, f in FACTORS], "source_unit string, target_unit string, factor decimal(14,9)")


def convert(values: DataFrame, factors: DataFrame, value: str = "value") -> DataFrame:
    """Adds converted, null with error unsupported_unit_mapping for other pairs."""
    joined = values.join(F.broadcast(factors), ["source_unit", "target_unit"], "left")
    error = F.when(F.col("factor").isNull(), F.lit("unsupported_unit_mapping"))
    return joined.withColumn("converted", (F.col(value) * F.col("factor")).cast("decimal(38,9)")).withColumn("error", error).drop("factor")


def scale(text: Column) -> Column:
    """Digits after the point of decimal text, less its exponent, at least 0."""
    digits = F.length(F.regexp_extract(text, r"\.([0-9]*)", 1))
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))
    return F.greatest(digits - power, F.lit(0))


def times(text: str, factor: Decimal) -> str:
    """Text of value times factor: the scales add, as in exact arithmetic."""
    return format(Decimal(text) * factor, "f")
