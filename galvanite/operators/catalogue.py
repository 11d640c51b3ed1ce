"""The constraints of the evidence tables, as one audit.

A table's checks are evaluated together in one scan; unique keys are one
aggregate each, and foreign keys one anti join each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.operators import constraints

_PAIR = "(data_origin = 'observed' AND execution_mode IN ('replay', 'live')) OR (data_origin = 'synthetic' AND execution_mode IN ('replay', 'simulation'))"
_CLASSES = "requirement_class IN ('required', 'conditional', 'recommended', 'optional')"
_TECHNIQUES = "technique IN ('cyclic_voltammetry', 'galvanostatic_electrolysis')"
_V1 = "schema_version = '1'"

#: Table -> rule -> what every row must meet (an unknown result passes).
CHECKS: dict[str, dict[str, str]] = {
    "campaigns": {
        "admissible_origin_mode": _PAIR,
        "known_event_stream_contract_version": "event_stream_contract_version IN (0, 1, 2)",
        "event_stream_position_non_negative": "event_stream_last_position >= 0",
        "hard_budget_positive": "hard_budget > 0",
        "per_attempt_estimate_positive": "per_attempt_estimate > 0",
        "attempt_estimate_within_hard_budget": "per_attempt_estimate <= hard_budget",
        "budget_unit_present": "length(trim(budget_unit)) > 0",
        "max_attempts_positive": "max_attempts >= 1",
        "known_stopping_rule": "stopping_rule = 'hard_budget_exhausted'",
    },
    "work_items": {"quarantine_states_its_reason": "state <> 'quarantined' OR quarantine_reason IS NOT NULL"},
    "jobs": {
        "attempt_count_non_negative": "attempt_count >= 0",
        "lease_generation_non_negative": "lease_generation >= 0",
        "lease_owner_and_expiry_together": "(lease_owner IS NULL) = (lease_expires_at IS NULL)",
        "lease_owner_and_token_together": "(lease_owner IS NULL) = (lease_token IS NULL)",
    },
    "attempts": {"ordinal_starts_at_one": "ordinal >= 1"},
    "observations": {
        "admissible_origin_mode": _PAIR,
        "byte_size_non_negative": "byte_size >= 0",
        "rejected_status_states_its_reason": "status NOT IN ('corrupted', 'invalidated') OR status_reason IS NOT NULL",
        "known_status": "status IN ('received', 'accepted', 'corrupted', 'invalidated', 'superseded')",
        "retained_receipt_states_its_reason": "status <> 'received' OR status_reason IS NOT NULL",
    },
    "attempt_outcomes": {
        "observation_only_when_bytes_arrived": "observation_id IS NULL OR status IN ('succeeded', 'corrupted', 'duplicate_suppressed', 'lease_lost')",
        "failed_status_carries_a_failure": "status NOT IN ('failed_retryable', 'failed_terminal') OR failure IS NOT NULL",
        "known_status": "status IN ('succeeded', 'timed_out', 'failed_retryable', 'failed_terminal', 'corrupted', 'cancelled', 'lease_lost', 'duplicate_suppressed')",
        "admissible_origin_mode": _PAIR,
    },
    "derived_metrics": {"non_accepted_metric_states_its_reason": "quality_status = 'accepted' OR quality_reason IS NOT NULL"},
    "events": {
        "sequence_starts_at_one": "sequence >= 1",
        "campaign_position_starts_at_one": "campaign_position >= 1",
        "schema_version_starts_at_one": "schema_version >= 1",
    },
    "storage_objects": {
        "known_object_state": "state IN ('pending', 'committed', 'orphaned')",
        "committed_object_is_verified": "state <> 'committed' OR (sha256 IS NOT NULL AND byte_size IS NOT NULL AND committed_at IS NOT NULL)",
        "known_classification": "classification IS NULL OR classification IN ('accepted_evidence', 'diagnostic_duplicate', 'diagnostic_orphan', 'quarantined', 'missing')",
        "classification_records_when_it_was_reached": "(classification IS NULL) = (reconciled_at IS NULL)",
        "classification_states_its_reason": "classification IS NULL OR classification_reason IS NOT NULL",
    },
    "source_artifacts": {
        "source_byte_size_non_negative": "byte_size >= 0",
        "source_admissible_origin_mode": _PAIR,
        "known_source_state": "state IN ('pending', 'committed', 'quarantined')",
        "committed_source_has_timestamp": "(state = 'committed') = (committed_at IS NOT NULL)",
        "quarantined_source_has_reason": "(state = 'quarantined') = (quarantine_reason IS NOT NULL)",
    },
    "normalised_observations": {"known_normalised_observation_technique": _TECHNIQUES},
    "import_profiles": {"known_import_profile_schema": _V1, "known_import_profile_technique": "technique = 'cyclic_voltammetry'"},
    "normalised_cv_observations": {"known_normalised_cv_schema": _V1, "normalised_cv_has_rows": "row_count >= 1", "normalised_cv_byte_size_non_negative": "byte_size >= 0", "normalised_cv_admissible_origin_mode": _PAIR},
    "cv_parser_records": {
        "known_source_format": "source_format IN ('generic_csv', 'gamry_dta')",
        "known_parser_status": "status IN ('accepted', 'rejected')",
        "parser_status_matches_observation": "(status = 'accepted' AND observation_id IS NOT NULL) OR (status = 'rejected' AND observation_id IS NULL)",
    },
    "cv_transformation_records": {"cv_transform_ordinal_starts_at_one": "ordinal >= 1"},
    "electrolysis_import_profiles": {"known_electrolysis_profile_schema": _V1, "known_electrolysis_profile_technique": "technique = 'galvanostatic_electrolysis'"},
    "normalised_electrolysis_observations": {"known_electrolysis_observation_schema": _V1, "electrolysis_observation_has_rows": "row_count >= 1", "electrolysis_observation_byte_size_non_negative": "byte_size >= 0", "electrolysis_observation_admissible_origin_mode": _PAIR},
    "electrolysis_transformation_records": {"electrolysis_transform_ordinal_starts_at_one": "ordinal >= 1"},
    "experiments": {"known_experiment_schema": _V1, "experiment_version_starts_at_one": "current_version >= 1", "known_experiment_technique": _TECHNIQUES, "experiment_admissible_origin_mode": _PAIR},
    "experiment_versions": {
        "experiment_snapshot_version_starts_at_one": "version >= 1",
        "experiment_snapshot_supersedes_predecessor": "(version = 1 AND supersedes_version IS NULL) OR (version > 1 AND supersedes_version = version - 1)",
    },
    "metadata_assertions": {
        "known_metadata_assertion_schema": _V1,
        "assertion_version_starts_at_one": "created_version >= 1",
        "known_assertion_origin": "origin IN ('source_file', 'user_supplied', 'inferred')",
        "known_assertion_transformation": "transformation IN ('none', 'parsed', 'unit_converted', 'derived')",
        "known_assertion_requirement_class": _CLASSES,
        "known_assertion_value_state": "value_state IN ('known', 'unknown', 'unavailable', 'not_applicable')",
    },
    "validation_runs": {"known_validation_schema": _V1, "known_release_decision": "release_status IN ('blocked', 'eligible')"},
    "validation_findings": {"known_finding_severity": "severity IN ('blocking', 'warning', 'unknown')", "known_finding_requirement_class": _CLASSES},
    "experiment_passports": {"known_passport_schema": _V1},
    "experiment_packages": {"known_experiment_package_schema": "schema_version IN ('1', '2', '3')", "experiment_package_not_empty": "archive_byte_size >= 1"},
    "budget_ledger": {
        "known_ledger_kind": "kind IN ('reserved', 'consumed', 'released', 'adjusted_up', 'adjusted_down')",
        "ledger_amount_positive": "amount > 0",
        "ledger_unit_present": "length(trim(unit)) > 0",
        "ledger_generation_positive": "lease_generation IS NULL OR lease_generation >= 1",
        "ledger_entry_shape": "(kind = 'reserved' AND reservation_entry_id IS NULL AND job_id IS NOT NULL AND lease_generation IS NOT NULL AND attempt_id IS NULL) OR (kind <> 'reserved' AND ((reservation_entry_id IS NULL AND job_id IS NULL AND lease_generation IS NULL) OR (reservation_entry_id IS NOT NULL AND job_id IS NOT NULL AND lease_generation IS NOT NULL)))",
    },
    "record_relations": {"no_self_relation": "subject_id <> object_id", "known_predicate": "predicate IN ('derived_from', 'supersedes', 'invalidates', 'replaces')"},
}
#: Fixed values: (table, rule, key, which rows it holds for).
UNIQUE: tuple[tuple[str, str, tuple[str, ...], str | None], ...] = (
    ("campaigns", "campaign_identity", ("campaign_id", "data_origin", "execution_mode"), None),
    ("work_items", "campaign_candidate", ("campaign_id", "candidate_id"), None),
    ("work_items", "campaign_identity", ("work_item_id", "campaign_id"), None),
    ("jobs", "idempotency_key", ("idempotency_key",), None),
    ("jobs", "work_item_identity", ("job_id", "work_item_id"), None),
    ("attempts", "work_item_ordinal", ("work_item_id", "ordinal"), None),
    ("attempts", "execution_identity", ("attempt_id", "work_item_id", "job_id"), None),
    ("observations", "one_accepted_per_work_item", ("work_item_id",), "status = 'accepted'"),
    ("attempt_outcomes", "one_success_per_work_item", ("work_item_id",), "status = 'succeeded'"),
    ("derived_metrics", "analysis", ("observation_id", "attempt_id", "name", "analysis_name", "analysis_version", "parameter_hash"), None),
    ("events", "aggregate_sequence", ("campaign_id", "aggregate_type", "aggregate_id", "sequence"), None),
    ("events", "campaign_position", ("campaign_id", "campaign_position"), None),
    ("cv_transformation_records", "observation_ordinal", ("observation_id", "ordinal"), None),
    ("electrolysis_transformation_records", "observation_ordinal", ("observation_id", "ordinal"), None),
    ("experiment_versions", "version", ("experiment_id", "version"), None),
    ("experiment_passports", "experiment_version", ("experiment_id", "experiment_version"), None),
    ("experiment_packages", "experiment_version", ("experiment_id", "experiment_version"), None),
    ("budget_ledger", "reservation_identity", ("entry_id", "campaign_id", "work_item_id", "job_id", "lease_generation"), None),
    ("budget_ledger", "reservation_execution", ("job_id", "lease_generation"), "kind = 'reserved'"),
    ("budget_ledger", "single_settlement", ("reservation_entry_id",), "kind IN ('consumed', 'released')"),
    ("budget_ledger", "single_actual_adjustment", ("reservation_entry_id",), "kind IN ('adjusted_up', 'adjusted_down')"),
    ("record_relations", "triple", ("subject_id", "predicate", "object_id"), None),
)
#: Fixed values: (table, rule, key, target, target's key).
FOREIGN: tuple[tuple[str, str, tuple[str, ...], str, tuple[str, ...]], ...] = (
    ("observations", "campaign_identity", ("campaign_id", "data_origin", "execution_mode"), "campaigns", ("campaign_id", "data_origin", "execution_mode")),
    ("attempt_outcomes", "campaign_identity", ("campaign_id", "data_origin", "execution_mode"), "campaigns", ("campaign_id", "data_origin", "execution_mode")),
    ("attempt_outcomes", "observation", ("observation_id", "attempt_id"), "observations", ("observation_id", "attempt_id")),
    ("derived_metrics", "observation", ("observation_id", "attempt_id"), "observations", ("observation_id", "attempt_id")),
    ("budget_ledger", "work_item_campaign", ("work_item_id", "campaign_id"), "work_items", ("work_item_id", "campaign_id")),
    ("budget_ledger", "job_work_item", ("job_id", "work_item_id"), "jobs", ("job_id", "work_item_id")),
    ("budget_ledger", "attempt_execution", ("attempt_id", "work_item_id", "job_id"), "attempts", ("attempt_id", "work_item_id", "job_id")),
    ("budget_ledger", "settlement_reservation_identity", ("reservation_entry_id", "campaign_id", "work_item_id", "job_id", "lease_generation"), "budget_ledger", ("entry_id", "campaign_id", "work_item_id", "job_id", "lease_generation")),
    ("experiment_versions", "experiment", ("experiment_id",), "experiments", ("experiment_id",)),
    ("experiment_versions", "superseded_version", ("experiment_id", "supersedes_version"), "experiment_versions", ("experiment_id", "version")),
    ("metadata_assertions", "experiment_version", ("experiment_id", "created_version"), "experiment_versions", ("experiment_id", "version")),
    ("validation_runs", "experiment_version", ("experiment_id", "experiment_version"), "experiment_versions", ("experiment_id", "version")),
    ("experiment_passports", "experiment_version", ("experiment_id", "experiment_version"), "experiment_versions", ("experiment_id", "version")),
    ("experiment_packages", "experiment_version", ("experiment_id", "experiment_version"), "experiment_versions", ("experiment_id", "version")),
    ("experiment_passports", "supersedes_passport", ("supersedes_passport_id",), "experiment_passports", ("passport_id",)),
    ("experiment_packages", "supersedes_package", ("supersedes_package_id",), "experiment_packages", ("package_id",)),
    ("experiment_packages", "passport", ("passport_id",), "experiment_passports", ("passport_id",)),
    ("experiment_packages", "object", ("object_uri",), "storage_objects", ("object_uri",)),
)


def failed_checks(name: str, rows: DataFrame, key: str) -> DataFrame:
    """(rule, subject) of every check of a table that a row fails: one scan."""
    flags = F.array_compact(F.array(*(F.when(~F.expr(c), F.lit(f"{name}.{rule}")) for rule, c in CHECKS[name].items())))
    return rows.select(F.explode(flags).alias("rule"), F.col(key).cast("string").alias("subject"))


def audit(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(rule, subject) of every constraint that the given tables break; a
    foreign key counts if its target is given. ``keys`` names each table's own
    key, which a failed check shows."""
    parts = [failed_checks(name, rows, keys[name]) for name, rows in tables.items() if name in CHECKS]
    parts += [constraints.unique(f"{t}.{rule}", tables[t], list(key), None if where is None else F.expr(where)) for t, rule, key, where in UNIQUE if t in tables]
    parts += [constraints.foreign(f"{t}.{rule}", tables[t], list(key), tables[target], list(own)) for t, rule, key, target, own in FOREIGN if t in tables and target in tables]
    return reduce(DataFrame.unionByName, parts)
