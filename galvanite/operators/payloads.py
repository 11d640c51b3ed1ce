"""What an event must say: registered types, versions and payload fields.

A payload is checked as a map of field to JSON text, parsed once; a rule is a
column, and an event's problem is the first rule that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.lifecycle import TRANSITIONS
from galvanite.functions.naming import admissible

#: Payload kind -> (required fields, optional fields). No other field may occur.
FIELDS: dict[str, tuple[str, str]] = {
    "campaign_created": ("name environment_id adapter_version data_origin execution_mode declaration declaration_hash state", ""),
    "campaign_state": ("state", "reason"),
    "work_item_queued": ("candidate_id candidate state", ""),
    "work_item_state": ("state", "reason"),
    "job": ("work_item_id state available_at attempt_count max_attempts command_version idempotency_key created_at updated_at", "lease_owner lease_token lease_expires_at heartbeat_at lease_generation last_failure"),
    "attempt_started": ("work_item_id ordinal state created_at", "job_id started_at"),
    "attempt_completed": ("work_item_id campaign_id state status cost data_origin execution_mode provenance finished_at", "job_id ordinal observation_id failure started_at"),
    "observation": ("observation_id work_item_id attempt_id media_type object_uri byte_size sha256 schema_version signal_kind quantities status data_origin execution_mode provenance received_at", "status_reason"),
    "budget": ("entry_id work_item_id job_id lease_generation kind amount unit reason recorded_at", "attempt_id reservation_entry_id"),
    "relation": ("relation_id subject_id predicate object_id reason recorded_at", ""),
}
#: Event type -> (aggregate, payload kind, states, kinds, statuses or predicates that it may carry). All are version 1.
TYPES: dict[str, tuple[str, str, str]] = {
    "campaign.created": ("campaign", "campaign_created", " ".join(sorted({*TRANSITIONS["campaign"], "completed", "budget_exhausted", "cancelled", "failed"}))),
    "campaign.started": ("campaign", "campaign_state", "active"),
    "campaign.paused": ("campaign", "campaign_state", "paused"),
    "campaign.resumed": ("campaign", "campaign_state", "active"),
    "campaign.completed": ("campaign", "campaign_state", "completed"),
    "campaign.cancelled": ("campaign", "campaign_state", "cancelled"),
    "campaign.failed": ("campaign", "campaign_state", "failed"),
    "campaign.budget_exhausted": ("campaign", "campaign_state", "budget_exhausted"),
    "observation.invalidated": ("campaign", "relation", "invalidates"),
    "observation.superseded": ("campaign", "relation", "supersedes"),
    "work_item.queued": ("work_item", "work_item_queued", "queued"),
    "work_item.accepted": ("work_item", "work_item_state", "accepted"),
    "work_item.quarantined": ("work_item", "work_item_state", "quarantined"),
    "work_item.rejected": ("work_item", "work_item_state", "rejected"),
    "work_item.cancelled": ("work_item", "work_item_state", "cancelled"),
    "job.enqueued": ("job", "job", "available"),
    "job.available": ("job", "job", "available"),
    "job.leased": ("job", "job", "leased"),
    "job.started": ("job", "job", "running"),
    "job.heartbeat": ("job", "job", "leased running"),
    "job.lease_expired": ("job", "job", "leased running"),
    "job.retry_scheduled": ("job", "job", "retry_scheduled"),
    "job.succeeded": ("job", "job", "succeeded"),
    "job.failed_terminal": ("job", "job", "failed_terminal"),
    "job.timed_out": ("job", "job", "timed_out"),
    "job.cancelled": ("job", "job", "cancelled"),
    "attempt.started": ("attempt", "attempt_started", "running"),
    "attempt.completed": ("attempt", "attempt_completed", " ".join(t for t in TRANSITIONS["attempt"]["running"])),
    "observation.accepted": ("attempt", "observation", "accepted"),
    "observation.retained": ("attempt", "observation", "received corrupted"),
    "budget.reserved": ("budget", "budget", "reserved"),
    "budget.consumed": ("budget", "budget", "consumed"),
    "budget.released": ("budget", "budget", "released"),
    "budget.adjusted": ("budget", "budget", "adjusted_up adjusted_down"),
}
#: Payload kind -> the field that must carry one of the values above, if it isn't the state.
SAYS = {"relation": "predicate", "observation": "status", "budget": "kind"}


def registry(events: DataFrame) -> DataFrame:
    """Events beside what their type asks for (a few dozen rows, broadcast)."""
    rows = [(t, a, k, FIELDS[k][0].split(), [*FIELDS[k][0].split(), *FIELDS[k][1].split()], SAYS.get(k, "state"), v.split()) for t, (a, k, v) in TYPES.items()]
    known = events.sparkSession.createDataFrame(rows, "event_type string, _aggregate string, _kind string, _required array<string>, _allowed array<string>, _says string, _values array<string>")
    return events.join(F.broadcast(known), "event_type", "left")


def payload_detail(payload: Column) -> Column:
    """What is wrong with a registered event's payload (a map), first rule
    first, or null."""
    _says = payload.getItem

    def _integer(field: str, least: int) -> Column:
        """False for a field that is there and no integer of at least ``least``."""
        return _says(field).isNull() | F.coalesce(_says(field).try_cast("bigint") >= least, F.lit(False))

    missing = F.array_sort(F.filter("_required", lambda k: payload[k].isNull()))
    unknown = F.array_sort(F.array_except(F.map_keys(payload), "_allowed"))
    says = payload[F.col("_says")]
    reserved = _says("kind") == "reserved"
    settles, attempt = _says("reservation_entry_id").isNotNull(), _says("attempt_id").isNotNull()
    kind = F.col("_kind")
    return (
        F.when(payload.isNull(), "not_an_object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.element_at(missing, 1)))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.element_at(unknown, 1)))
        .when(~F.array_contains("_values", says), F.concat(F.col("_says"), F.lit(":"), says))
        .when(kind.isin("campaign_state", "work_item_state") & _says("state").isin("failed", "rejected", "quarantined") & (F.coalesce(_says("reason"), F.lit("")) == ""), "reason_required")
        .when((kind == "attempt_completed") & (_says("state") != _says("status")), "status_differs_from_state")
        .when((kind == "attempt_completed") & (_says("status") == "succeeded") & _says("observation_id").isNull(), "success_without_observation")
        .when(kind.isin("campaign_created", "attempt_completed", "observation") & ~admissible(_says("data_origin"), _says("execution_mode")), "inadmissible_environment")
        .when((kind == "budget") & ~F.coalesce(_says("amount").try_cast("decimal(38,18)") > 0, F.lit(False)), "amount_not_positive")
        .when((kind == "budget") & ~_integer("lease_generation", 1), "bad_generation")
        .when((kind == "budget") & reserved & (settles | attempt), "reservation_names_execution")
        .when((kind == "budget") & ~reserved & ~settles, "settlement_without_reservation")
        .when((kind == "job") & ~(_integer("lease_generation", 0) & _integer("attempt_count", 0) & _integer("max_attempts", 1)), "bad_count")
        .when(kind.isin("attempt_started", "attempt_completed") & ~_integer("ordinal", 1), "bad_ordinal")
        .when((kind == "observation") & (~_integer("byte_size", 0) | (F.length(_says("sha256")) != 64)), "bad_object")
        .when((kind == "campaign_created") & (F.length(_says("declaration_hash")) != 64), "bad_declaration_hash")
        .when((kind == "relation") & (_says("subject_id") == _says("object_id")), "relates_to_itself")
    )


def problems(events: DataFrame) -> DataFrame:
    """(campaign_id, campaign_position, event_id, code, detail): the first
    problem of each event's envelope and payload. Events have event_id,
    campaign_id, campaign_position, event_type, schema_version,
    aggregate_type, aggregate_id, causation_id and payload. A narrow
    transformation: nothing is shuffled."""
    known = registry(events)
    own = (F.col("aggregate_type") == "campaign") & (F.col("aggregate_id").cast("string") != F.col("campaign_id").cast("string"))

    def judged(x: Column) -> Column:
        payload, detail = x["payload"], x["detail"]
        elsewhere = payload["campaign_id"] != F.col("campaign_id").cast("string")
        other = F.col("event_type").isin("observation.accepted", "observation.retained") & (payload["attempt_id"] != F.col("aggregate_id").cast("string"))
        code = (
            F.when(F.col("_aggregate").isNull(), "unknown_event_type")
            .when(F.col("schema_version") != 1, "unsupported_event_version")
            .when(F.col("aggregate_type") != F.col("_aggregate"), "event_aggregate_type_mismatch")
            .when((F.col("event_type") != "campaign.created") & F.col("causation_id").isNull(), "event_causation_required")
            .when(detail.isNotNull(), "invalid_event_payload")
            .when(own | F.coalesce(elsewhere, F.lit(False)) | F.coalesce(other, F.lit(False)), "event_identity_mismatch")
        )
        return F.struct(code.alias("code"), detail.alias("detail"))

    # the parsed payload is bound once, as a lambda's variable; the explosion keeps the filter from being pushed into copies of it
    parsed = F.array(F.from_json("payload", "map<string,string>"))
    detailed = F.transform(parsed, lambda p: F.struct(p.alias("payload"), payload_detail(p).alias("detail")))
    found = known.withColumn("f", F.explode(F.filter(F.transform(detailed, judged), lambda f: f["code"].isNotNull())))
    return found.select("campaign_id", "campaign_position", "event_id", "f.code", F.when(F.col("f.code") == "invalid_event_payload", F.col("f.detail")).alias("detail"))


def contract_gate(version: Column) -> Column:
    """What a stream of this contract version can be used for."""
    return F.when(version == 0, "legacy").when(version == 1, "readable").when(version == 2, "replay_complete").otherwise("unknown")
