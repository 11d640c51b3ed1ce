"""Versioned metadata assertions and release decisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Who asserted a field, weakest first. Of equal origins the later assertion wins.
ORIGINS = ("source_file", "inferred", "user_supplied")
#: Fields that must be known before a release.
REQUIRED: Mapping[str, tuple[str, ...]] = {
    "cyclic_voltammetry": ("source_artifact", "observation", "potential_axis", "current_axis"),
    "galvanostatic_electrolysis": ("source_artifact", "observation", "time_axis", "potential_axis", "current_axis", "current_quantity_kind"),
}


def rank_of(value: Column, ranked: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(ranked):
        out = F.when(value == name, i).otherwise(out)
    return out


def resolve_fields(assertions: DataFrame, key: list[str], priority: Column, order: str) -> DataFrame:
    """The active assertion of each field: highest priority, then latest."""
    rest = [c for c in assertions.columns if c not in (*key, order)]
    best = F.max(F.struct(priority.alias("_p"), F.col(order), *rest)).alias("_best")
    return assertions.groupBy(*key).agg(best).select(*key, F.col(f"_best.{order}").alias(order), *(F.col(f"_best.{c}").alias(c) for c in rest))


def severity(required: Column, state: Column, requirement: Column) -> Column:
    """blocking, unknown, warning or null of one field, first rule first."""
    return (
        F.when(required & (state.isNull() | (state != "known")), "blocking")
        .when(state.isin("known", "not_applicable"), F.lit(None))
        .when(requirement == "required", "blocking")
        .when(state == "unknown", "unknown")
        .when(state == "unavailable", "warning")
    )


def findings(resolved: DataFrame, required: tuple[str, ...], key: str) -> DataFrame:
    """(key, field_name, severity) from active assertions (key, field_name,
    state, requirement_class) and the required fields; one of these
     without an assertion is a finding too."""
    subjects = resolved.select(key).distinct()
    wanted = subjects.withColumn("field_name", F.explode(F.array(*map(F.lit, required)))).withColumn("_required", F.lit(True))
    every = wanted.join(resolved, [key, "field_name"], "full_outer")
    level = severity(F.coalesce("_required", F.lit(False)), F.col("state"), F.col("requirement_class"))
    return every.select(key, "field_name", level.alias("severity")).where("severity is not null")


def release_decision(subjects: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Counts by severity and whether each subject may be released: any
    blocking finding blocks it."""
    one = lambda s: F.coalesce(F.count_if(F.col("severity") == s), F.lit(0)).alias(f"{s}_count")
    counts = subjects.select(key).distinct().join(found, key, "left").groupBy(key).agg(one("blocking"), one("unknown"), one("warning"))
    return counts.withColumn("decision", F.when(F.col("blocking_count") > 0, "blocked").otherwise("eligible"))


def broken_versions(versions: DataFrame, key: str, version: str, supersedes: str) -> DataFrame:
    """Versions that don't supersede the one just before them."""
    first = (F.col(version) == 1) & F.col(supersedes).isNull()
    return versions.where(~(first | F.coalesce(F.col(supersedes) == F.col(version) - 1, F.lit(False))))
