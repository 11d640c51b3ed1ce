"""Profiles of delimited tables and archive members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = "decimal(38,18)"


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: non_empty, missing, distinct_values, inferred_type,
    and the least and greatest as source text (by number if all are numbers,
    else by text). One unpivot and one aggregate for all columns."""
    long = rows.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column_name", "cell")
    cell = F.col("cell")
    full = cell.isNotNull() & (F.trim(cell) != "")
    number = F.trim(cell).try_cast(_NUMBER)
    integer = F.trim(cell).rlike(r"^[+-]?\d+$")
    by_text = lambda f: f(F.when(full, cell))
    by_number = lambda f: f(F.when(full & number.isNotNull(), F.struct(number.alias("n"), cell.alias("t"))))
    out = long.groupBy("column_name").agg(
        F.count_if(full).alias("non_empty"),
        F.count_if(~full | cell.isNull()).alias("missing"),
        F.count_distinct(F.when(full, cell)).alias("distinct_values"),
        F.bool_and(F.when(full, integer)).alias("_integer"),
        F.bool_and(F.when(full, number.isNotNull())).alias("_decimal"),
        by_text(F.min).alias("_least_text"), by_text(F.max).alias("_most_text"), by_number(F.min).alias("_least"), by_number(F.max).alias("_most"),
    )
    kind = F.when(F.col("non_empty") == 0, "empty").when(F.col("_integer"), "integer").when(F.col("_decimal"), "decimal").otherwise("text")
    shown: list[Column] = [F.when(F.col("_decimal"), F.col(f"_{x}.t")).otherwise(F.col(f"_{x}_text")).alias(f"{x}_value") for x in ("least", "most")]
    return out.select("column_name", "non_empty", "missing", "distinct_values", kind.alias("inferred_type"), *shown)


def table_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """row_count and duplicate_row_count, in one aggregate over distinct rows."""
    kinds = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return kinds.agg(F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("duplicate_row_count"))


def shape(name: Column) -> Column:
    """A file name with every number as #."""
    return F.regexp_replace(name, r"[-+]?\d+(?:\.\d+)?", "#")


def member_shapes(members: DataFrame, name: str, order: str) -> DataFrame:
    """Shapes with their counts and first member."""
    least = F.min(F.struct(order, name)).alias("_first")
    return members.groupBy(shape(F.col(name)).alias("shape")).agg(F.count("*").alias("n"), least).select("shape", "n", F.col(f"_first.{name}").alias("example"))


def header_name(header: Column) -> Column:
    return F.when(header.rlike(r"^.*\S\s*\[[^\]]+\]\s*$"), F.trim(F.regexp_extract(header, r"^(.*\S)\s*\[([^\]]+)\]\s*$", 1))).otherwise(F.trim(header))


def header_unit(header: Column) -> Column:
    """The unit in ``name [unit]``, or null."""
    return F.nullif(F.regexp_extract(header, r"^(.*\S)\s*\[([^\]]+)\]\s*$", 2), F.lit(""))


def line_ending(text: Column) -> Column:
    """crlf, lf, cr, mixed or none."""
    count = lambda what: F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))
    crlf = (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    cr, lf = count("\r") - crlf, count("\n") - crlf
    kinds = (crlf > 0).cast("int") + (cr > 0).cast("int") + (lf > 0).cast("int")
    return F.when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").when(cr > 0, "cr").otherwise("none")


def ragged(rows: DataFrame, cells: str, width: int) -> DataFrame:
    """One row: row_count, duplicate_row_count and ragged_row_count of rows
    given as arrays of cells, against a header of ``width`` columns."""
    kinds = rows.groupBy(cells).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return kinds.agg(total("n").alias("row_count"), total(F.col("n") - 1).alias("duplicate_row_count"), total(F.when(F.size(cells) != width, F.col("n")).otherwise(0)).alias("ragged_row_count"))
