"""Assertions about experiments: what an observation brings, what an editor
may add, what a release needs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.canonical import flat_content_id
from galvanite.operators import experiments

#: Metadata fields and their requirement classes, by technique.
METADATA: Mapping[str, Mapping[str, str]] = {
    "cyclic_voltammetry": {
        "reference_scale": "conditional",
        "potential_treatment": "conditional",
        "current_basis": "conditional",
        "electrode_role": "conditional",
        "geometric_area": "conditional",
        "contact_area": "conditional",
        "scan_rate": "recommended",
        "cycle_information": "recommended",
    },
    "galvanostatic_electrolysis": {
        "current_sign_convention": "conditional",
        "current_basis": "conditional",
        "electrode_area": "conditional",
        "reference_scale": "conditional",
        "potential_treatment": "conditional",
        "cell_geometry": "recommended",
        "sampling_interval": "recommended",
        "interruptions": "recommended",
        "chemical_analysis": "optional",
    },
}
#: Fields that a technique doesn't have, recorded as such.
NOT_APPLICABLE = {"cyclic_voltammetry": (), "galvanostatic_electrolysis": ("scan_rate", "cycle_information")}
#: Area bases of a current density, and the basis of a total current.
AREA_BASES, TOTAL = ("geometric_area", "electrochemically_active_area", "contact_or_wetted_area"), "total_current"
#: Fields that an electrolysis profile owns: its required ones, its metadata and what doesn't apply.
PROFILE_FIELDS = (*experiments.REQUIRED["galvanostatic_electrolysis"], *METADATA["galvanostatic_electrolysis"], *NOT_APPLICABLE["galvanostatic_electrolysis"])
AUXILIARY = "auxiliary_result."


def experiment_id(observation: Column) -> Column:
    return flat_content_id("experiment", observation_id=observation)


def initial_assertions(observations: DataFrame, series: DataFrame, metadata: DataFrame) -> DataFrame:
    """What an observation asserts when its experiment begins, a row each:
    experiment_id, observation_id, field_name, requirement_class, origin,
    transformation, state, value, unit.

    ``observations`` has (observation_id, source_artifact_id, technique) and
    parser_record_id where a parser left a record of what it read (or null),
    ``series`` (observation_id, role, source_column, source_unit, unit),
    ``metadata`` (observation_id, field_name, state, value, unit). A metadata
    field that isn't declared is unknown; no value is inferred."""
    say = lambda rows, field, requirement, origin, how, state, value, unit: rows.select(
        "observation_id", field.alias("field_name"), F.lit(requirement).alias("requirement_class") if isinstance(requirement, str) else requirement.alias("requirement_class"),
        F.lit(origin).alias("origin"), how.alias("transformation"), state.alias("state"), value.cast("string").alias("value"), unit.cast("string").alias("unit"),
    )
    known, none, null = F.lit("known"), F.lit("none"), F.lit(None)
    source = say(observations, F.lit("source_artifact"), "required", "source_file", none, known, F.col("source_artifact_id"), null)
    whole = say(observations, F.lit("observation"), "required", "source_file", F.lit("derived"), known, F.col("observation_id"), null)
    record = F.col("parser_record_id") if "parser_record_id" in observations.columns else F.lit(None).cast("string")
    parsed = say(observations.where(record.isNotNull()), F.lit("parser_record"), "required", "source_file", F.lit("parsed"), known, record, null)
    typed = series.join(observations.select("observation_id", "technique"), "observation_id")
    electrolysis, current = F.col("technique") == "galvanostatic_electrolysis", F.col("role").isin("current", "current_density")
    axis = F.when(current, "current_axis").otherwise(F.concat("role", F.lit("_axis")))
    mapped = typed.where(F.col("role").isin("potential", "current", "current_density") | (electrolysis & (F.col("role") == "time")))
    axes = say(mapped, axis, "required", "user_supplied", F.when(F.col("source_unit") == F.col("unit"), "parsed").otherwise("unit_converted"), known, F.col("source_column"), F.col("unit"))
    kinds = say(typed.where(electrolysis & current), F.lit("current_quantity_kind"), "required", "user_supplied", none, known, F.col("role"), null)
    fields = [(t, f, c, None) for t, fs in METADATA.items() for f, c in fs.items()] + [(t, f, "optional", "not_applicable") for t, fs in NOT_APPLICABLE.items() for f in fs]
    wanted = observations.join(F.broadcast(observations.sparkSession.createDataFrame(fields, "technique string, field_name string, _class string, _state string")), "technique")
    declared = wanted.join(metadata, ["observation_id", "field_name"], "left")
    context = say(declared, F.col("field_name"), F.col("_class"), "user_supplied", none, F.coalesce("_state", "state", F.lit("unknown")), F.when(F.col("_state").isNull(), F.col("value")), F.when(F.col("_state").isNull(), F.col("unit")))
    rows = reduce(DataFrame.unionByName, (source, whole, parsed, axes, kinds, context))
    return rows.select(experiment_id(F.col("observation_id")).alias("experiment_id"), *rows.columns)


def edit_problems(edits: DataFrame, assertions: DataFrame) -> DataFrame:
    """What each edit of an experiment breaks, or null: ``edits`` has edit_id,
    experiment_id, technique, version, expected_version, field_name, origin,
    supplements, supersedes; ``assertions`` (experiment_id, assertion_id,
    field_name, origin, active). Adds problem, the first rule broken."""
    named = lambda x: assertions.select("experiment_id", F.col("assertion_id").alias(x), F.col("field_name").alias(f"_{x}_field"), F.col("origin").alias(f"_{x}_origin"), F.col("active").alias(f"_{x}_active"))
    rows = edits.join(named("supplements"), ["experiment_id", "supplements"], "left").join(named("supersedes"), ["experiment_id", "supersedes"], "left")
    field, electrolysis = F.col("field_name"), F.col("technique") == "galvanostatic_electrolysis"
    problem = (
        F.when(F.col("expected_version") != F.col("version"), "version_conflict")
        .when(F.col("origin") != "user_supplied", "origin_not_user")
        .when(electrolysis & field.startswith(AUXILIARY), "auxiliary_results_come_from_records")
        .when(electrolysis & field.isin(*PROFILE_FIELDS), "profile_owns_field")
        .when(F.col("supplements").isNotNull() & ~F.coalesce(F.col("_supplements_field") == field, F.lit(False)), "supplements_other_field")
        .when(F.col("supersedes").isNotNull() & ~F.coalesce(F.col("_supersedes_active"), F.lit(False)), "supersedes_inactive")
        .when(F.col("_supersedes_origin") == "source_file", "source_assertions_are_fixed")
        .when(F.col("supersedes").isNotNull() & ((F.col("_supersedes_origin") != "user_supplied") | (F.col("_supersedes_field") != field)), "supersedes_other_assertion")
    )
    return rows.select(*edits.columns, problem.alias("problem"))


def validated(active: DataFrame, experiments_: DataFrame, key: str = "experiment_id") -> DataFrame:
    """(key, field_name, severity) of every finding, by technique.

    ``active`` has one resolved assertion for each field (key, field_name,
    state, value, requirement_class), ``experiments_`` (key, technique).
    Electrolysis also needs a current kind, basis and area that fit each
    other, and refuses known fields that its profile doesn't own, but for
    auxiliary results."""
    required = experiments_.sparkSession.createDataFrame([(t, f) for t, fs in experiments.REQUIRED.items() for f in fs], "technique string, field_name string")
    wanted = experiments_.join(F.broadcast(required), "technique").select(key, "field_name", F.lit(True).alias("_required"))
    every = wanted.join(active, [key, "field_name"], "full_outer").join(experiments_.select(key, "technique"), key)
    electrolysis, field = F.col("technique") == "galvanostatic_electrolysis", F.col("field_name")
    foreign = electrolysis & ~field.isin(*PROFILE_FIELDS) & ~field.startswith(AUXILIARY) & (F.col("state") == "known")
    usual = experiments.severity(F.coalesce("_required", F.lit(False)), F.col("state"), F.col("requirement_class"))
    found = every.select(key, "field_name", F.when(foreign, "blocking").otherwise(usual).alias("severity"))
    of = lambda name, what: F.first(F.when(field == name, F.col(what)), ignorenulls=True)
    context = active.join(experiments_.where(electrolysis).select(key), key, "left_semi").groupBy(key).agg(of("current_quantity_kind", "value").alias("kind"), of("current_basis", "state").alias("b"), of("current_basis", "value").alias("basis"), of("electrode_area", "state").alias("area"))
    context = experiments_.where(electrolysis).select(key).join(context, key, "left")
    density = (F.col("kind") == "current_density") & (F.col("b") == "known") & F.col("basis").isin(*AREA_BASES) & (F.col("area") == "known")
    total = (F.col("kind") == "current") & (F.col("b") == "known") & (F.col("basis") == TOTAL) & (F.col("area") == "not_applicable")
    misfit = context.where(~F.coalesce(density | total, F.lit(False))).select(key, F.lit("current_basis").alias("field_name"), F.lit("blocking").alias("severity"))
    kept = found.where("severity is not null").join(misfit.select(key, "field_name"), [key, "field_name"], "left_anti")
    return kept.unionByName(misfit)


def passports(decisions: DataFrame, key: str = "experiment_id") -> DataFrame:
    """(key, passport_id, release_status, problem) of release requests:
    ``decisions`` has key, version, validated_version, decision, release,
    released_at. A blocked experiment has a preview at most; the identity
    covers the body, not the time of release."""
    status = F.when(F.col("release"), "released").otherwise("preview")
    problem = (
        F.when(F.col("validated_version") != F.col("version"), "other_version_validated")
        .when(F.col("release") & (F.col("decision") == "blocked"), "blocked")
        .when(F.col("release") != F.col("released_at").isNotNull(), "release_time_mismatch")
    )
    own = flat_content_id("passport", experiment_id=F.col(key), version=F.col("version"), decision=F.col("decision"), release_status=status)
    return decisions.select(key, F.when(problem.isNull(), own).alias("passport_id"), F.when(problem.isNull(), status).alias("release_status"), problem.alias("problem"))


def first_versions(versions: DataFrame, key: str, version: str, item: str) -> DataFrame:
    """(key, item, created_version, last_version): each assertion is stored
    once, with the version that brought it."""
    return versions.groupBy(key, item).agg(F.min(version).alias("created_version"), F.max(version).alias("last_version"))


def latest(rows: DataFrame, key: str, version: str, *values: str) -> DataFrame:
    """The newest passport or package of each experiment."""
    return rows.groupBy(key).agg(F.max(F.struct(version, *values)).alias("m")).select(key, f"m.{version}", *(f"m.{v}" for v in values))
