"""Rebuilding a campaign's state from its event log, in batch.

Events: campaign_id, aggregate_type, aggregate_id, sequence,
campaign_position, event_id, event_type, causation_id, correlation_id and a
JSON payload. State is what each aggregate's last event says; what the order
forbids is reported as violations, the first of each campaign."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galvanite.functions import lifecycle
from galvanite.operators import budget, payloads, streams
from galvanite.operators.tables import parts_for

#: Types whose last state isn't the one value that their payload may carry.
_STATELESS = ("observation.invalidated", "observation.superseded", "job.heartbeat", "job.lease_expired", "observation.accepted", "observation.retained", "budget.reserved", "budget.consumed", "budget.released", "budget.adjusted")
#: Campaign states that end it, and attempt states that may still change.
OVER = ("completed", "cancelled", "failed", "budget_exhausted")
OPEN_ATTEMPT, OPEN_ITEM = ("pending", "leased", "running"), ("proposed", "validated", "queued", "quarantined")
_AGGREGATE = ["campaign_id", "aggregate_type", "aggregate_id"]


def _field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def _state() -> Column:
    """The state an event sets: what its type says, or the payload's status
    (an attempt's completion) or state (a campaign's creation); null if none."""
    kind = F.col("event_type")
    said = {name: values for name, (_, _, values) in payloads.TYPES.items() if name not in (*_STATELESS, "attempt.completed", "campaign.created")}
    return F.when(kind == "attempt.completed", _field("status")).when(kind == "campaign.created", F.coalesce(_field("state"), F.lit("draft"))).otherwise(_looked_up(said, kind))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    """The value of a small table that stands in the plan as one constant."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def state_events(events: DataFrame) -> DataFrame:
    """Events that set a state, with it."""
    return events.withColumn("state", _state()).where("state is not null")


def projections(events: DataFrame) -> DataFrame:
    """(campaign_id, aggregate_type, aggregate_id, sequence, state) now."""
    return streams.last_state(state_events(events), _AGGREGATE, "sequence", "state").drop("n_events")


def ledger(events: DataFrame) -> DataFrame:
    """Budget events as ledger rows with exact amounts."""
    return events.where(F.col("event_type").startswith("budget.")).select("campaign_id", "campaign_position", _field("entry_id").alias("entry_id"), _field("kind").alias("kind"), _field("amount").try_cast("decimal(38,18)").alias("amount"), _field("unit").alias("unit"), _field("reservation_entry_id").alias("settles"))


def totals(events: DataFrame, limit: Column) -> DataFrame:
    return budget.usage(ledger(events), "campaign_id", limit)


#: The rules, in the order in which they count at one position.
RULES = (
    "campaign_position_gap", "aggregate_sequence_gap", "incomplete_event_stream", "unknown_event_type", "event_aggregate_type_mismatch", "event_causation_required",
    "invalid_event_causation", "illegal_transition", "lease_generation_fell", "immutable_field_changed", "reservation_settled_twice", "adjustment_without_consumption",
)


#: The rule that needs another event, the cause.
_CAUSE = RULES.index("invalid_event_causation")


def violations(events: DataFrame) -> DataFrame:
    """(campaign_id, campaign_position, rank, rule, detail) of every rule that
    an event breaks. All rules are columns over three shared windows (the
    stream, the aggregate, the reservation) and one self-join on the cause."""
    parts = parts_for(events)
    stream = Window.partitionBy("campaign_id").orderBy("campaign_position")
    own = Window.partitionBy(*_AGGREGATE).orderBy("sequence")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("campaign_id", "_settles").orderBy("campaign_position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_job = F.col("aggregate_type") == "job"
    job = lambda name: F.when(is_job, _field(name))
    fixed = F.when(is_job & _field("work_item_id").isNotNull(), F.concat_ws("|", *(_field(x) for x in ("work_item_id", "max_attempts", "command_version", "idempotency_key"))))
    aggregate = _looked_up({name: kind for name, (kind, _, _) in payloads.TYPES.items()}, F.col("event_type"))
    budgeted = F.col("event_type").startswith("budget.")
    when = lambda condition, detail: F.when(condition, detail.cast("string"))
    made = F.col("event_type") == "campaign.created"
    # rows go narrow through the windows: a rule's detail, null for nearly all, takes the place of what it was made from
    alone = {
        "_d2": when(made != (F.col("campaign_position") == 1), F.col("event_type")), "_d3": when(aggregate.isNull(), F.col("event_type")),
        "_d4": when(aggregate != F.col("aggregate_type"), F.col("aggregate_type")), "_d5": when(~made & F.col("causation_id").isNull(), F.col("event_type")),
    }
    cause_of = ["causation_id", "correlation_id"]
    rows = events.select(
        "campaign_id", "campaign_position", *_AGGREGATE[1:], "sequence", *cause_of, *(c.alias(k) for k, c in alone.items()), _state().alias("_state"), job("lease_generation").try_cast("long").alias("_generation"),
        fixed.alias("_fixed"), F.when(budgeted, _field("reservation_entry_id")).alias("_settles"), F.when(budgeted, _field("kind")).alias("_kind"),
    ).repartition(parts, "campaign_id")
    moves = [f"{m}:{s} to {t}" for m, states in lifecycle.TRANSITIONS.items() for s, targets in states.items() for t in targets]
    move = F.concat(F.col("_source"), F.lit(" to "), F.col("_state"))
    legal = F.concat(F.col("aggregate_type"), F.lit(":"), move).isin(*moves)
    rows = rows.withColumns({"_sequence": F.row_number().over(own).cast("long"), "_source": F.last("_state", True).over(before), "_before": F.last("_generation", True).over(before), "_first": F.first("_fixed", True).over(own)})
    of_aggregate = {
        "_d1": when(F.col("sequence") != F.col("_sequence"), F.col("_sequence")), "_d7": when(F.col("_source").isNotNull() & F.col("_state").isNotNull() & ~legal, move),
        "_d8": when(F.col("_generation") < F.col("_before"), F.col("_generation")), "_d9": when(F.col("_fixed") != F.col("_first"), F.col("_fixed")),
    }
    rows = rows.select("campaign_id", "campaign_position", *cause_of, "_settles", "_kind", *alone, *(c.alias(k) for k, c in of_aggregate.items()))
    rows = rows.withColumn("_position", F.row_number().over(stream).cast("long"))
    spent, settled, adjusted = F.col("_kind") == "consumed", F.col("_kind").isin("consumed", "released"), F.col("_kind").isin("adjusted_up", "adjusted_down")
    count = lambda c: F.when(F.col("_settles").isNotNull(), F.count_if(c).over(up_to))
    rows = rows.withColumns({"_spent": count(spent), "_settled": count(settled), "_adjusted": count(adjusted)})
    of_stream = {
        "_d0": when(F.col("campaign_position") != F.col("_position"), F.col("_position")), "_d10": when(settled & (F.col("_settled") > 1), F.col("_settles")),
        "_d11": when(adjusted & ((F.col("_spent") == 0) | (F.col("_adjusted") > 1)), F.col("_settles")),
    }
    found = {**{k: F.col(k) for k in (*alone, *of_aggregate)}, **of_stream}
    flag = lambda i, d: F.when(d.isNotNull(), F.struct(F.lit(i).alias("rank"), F.lit(RULES[i]).alias("rule"), d.alias("detail")))
    flags = F.array_compact(F.array(*(flag(i, found[f"_d{i}"]) for i in range(len(RULES)) if i != _CAUSE)))
    rows = rows.select("campaign_id", "campaign_position", *cause_of, flags.alias("_flags"))
    causes = events.select(F.col("event_id").alias("_event"), F.col("campaign_id").alias("_stream"), F.col("campaign_position").alias("_at"), F.col("correlation_id").alias("_correlation"))
    rows = rows.repartition(2 * parts, "causation_id").join(causes.repartition(2 * parts, "_event"), F.col("causation_id") == F.col("_event"), "left")
    cause = F.when(F.col("causation_id").isNull(), F.lit(None)).when(F.col("_event").isNull(), "missing_cause").when(F.col("_stream") != F.col("campaign_id"), "other_stream").when(F.col("_at") >= F.col("campaign_position"), "not_prior").when(~F.col("correlation_id").eqNullSafe(F.col("_correlation")), "other_correlation")
    every = F.concat("_flags", F.array_compact(F.array(flag(_CAUSE, cause))))
    return rows.select("campaign_id", "campaign_position", F.explode(every).alias("f")).select("campaign_id", "campaign_position", "f.*")


def first_violations(events: DataFrame) -> DataFrame:
    """(campaign_id, campaign_position, rule, detail): the first of each
    broken campaign; sound campaigns have none."""
    least = F.min(F.struct("campaign_position", "rank", "rule", "detail")).alias("p")
    return violations(events).groupBy("campaign_id").agg(least).select("campaign_id", "p.campaign_position", "p.rule", "p.detail")


def terminal_conflicts(state: DataFrame) -> DataFrame:
    """(campaign_id, rule): campaigns that are over with attempts still open,
    or completed with work items still open."""
    last = F.first(F.when(F.col("aggregate_type") == "campaign", F.col("state")), ignorenulls=True)
    open_attempts = F.count_if((F.col("aggregate_type") == "attempt") & F.col("state").isin(*OPEN_ATTEMPT))
    open_items = F.count_if((F.col("aggregate_type") == "work_item") & F.col("state").isin(*OPEN_ITEM))
    sums = state.groupBy("campaign_id").agg(last.alias("campaign"), open_attempts.alias("attempts"), open_items.alias("items"))
    over = F.col("campaign").isin(*OVER)
    rule = F.when(over & (F.col("attempts") > 0), "open_attempt").when((F.col("campaign") == "completed") & (F.col("items") > 0), "open_work_item")
    return sums.withColumn("rule", rule).where("rule is not null").select("campaign_id", "rule")


def compare(replayed: DataFrame, stored: DataFrame) -> DataFrame:
    """Aggregates whose replayed and stored states differ."""
    return streams.difference(replayed, stored, _AGGREGATE, ["state", "sequence"])


#: Sections of a replayed campaign: key, fields that never change, fields that a rebuild sets.
SECTIONS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "campaigns": (["campaign_id"], ["name", "environment_id", "created_at"], ["state", "updated_at"]),
    "work_items": (["campaign_id", "work_item_id"], ["candidate_id", "created_at"], ["state", "quarantine_reason", "updated_at"]),
    "jobs": (["campaign_id", "job_id"], ["work_item_id", "max_attempts", "command_version", "idempotency_key"], ["state", "lease_owner", "lease_expires_at", "lease_generation", "attempt_count", "last_failure", "last_event_id"]),
    "attempts": (["campaign_id", "attempt_id"], ["work_item_id", "job_id", "ordinal", "status", "observation_id", "failure"], ["state"]),
    "observations": (["campaign_id", "attempt_id", "observation_id"], ["work_item_id", "object_uri", "byte_size", "sha256", "status"], []),
    "budget": (["campaign_id"], ["reserved", "consumed", "released", "adjusted_up", "adjusted_down", "outstanding", "unit"], []),
}


def sections(events: DataFrame) -> dict[str, DataFrame]:
    """The six tables of a replay, each one aggregate over its own events.

    campaigns, work_items, jobs, attempts (with their outcomes), observations
    and budget; keys and fields as in ``SECTIONS``. Events also need
    occurred_at. A job's lease and failure are those of its last event, an
    observation that is recorded again is kept as first recorded."""
    order = "campaign_position"
    said = lambda *names: [_field(n).alias(n) for n in names]
    typed = events.withColumn("_state", _state())
    of = lambda *kinds: typed.where(F.col("event_type").isin(*kinds))

    def folded(rows: DataFrame, key: str, first: list[Column], last: list[Column]) -> DataFrame:
        head, tail = F.min(F.struct(order, *first)).alias("f"), F.max(F.struct(order, *last)).alias("l")
        return rows.groupBy("campaign_id", F.col("aggregate_id").alias(key)).agg(head, tail).drop(f"f.{order}")

    fields = lambda key: SECTIONS[key][0] + SECTIONS[key][1] + SECTIONS[key][2]
    of_campaign = typed.where((F.col("aggregate_type") == "campaign") & F.col("_state").isNotNull())
    campaigns = folded(of_campaign, "_id", [*said("name", "environment_id"), F.col("occurred_at").alias("created_at")], [F.col("_state").alias("state"), F.col("occurred_at").alias("updated_at")])
    of_item = typed.where((F.col("aggregate_type") == "work_item") & F.col("_state").isNotNull())
    items = folded(of_item, "work_item_id", [*said("candidate_id"), F.col("occurred_at").alias("created_at")], [F.col("_state").alias("state"), F.when(F.col("_state") == "quarantined", _field("reason")).alias("quarantine_reason"), F.col("occurred_at").alias("updated_at")])
    of_job = typed.where(F.col("aggregate_type") == "job")
    job_last = [_field("state").alias("state"), *said("lease_owner", "lease_expires_at"), _field("lease_generation").try_cast("long").alias("lease_generation"), _field("attempt_count").try_cast("long").alias("attempt_count"), *said("last_failure"), F.col("event_id").alias("last_event_id")]
    jobs = folded(of_job, "job_id", [*said("work_item_id"), _field("max_attempts").try_cast("long").alias("max_attempts"), *said("command_version", "idempotency_key")], job_last)
    of_attempt = of("attempt.started", "attempt.completed")
    attempts = folded(of_attempt, "attempt_id", [*said("work_item_id", "job_id"), _field("ordinal").try_cast("long").alias("ordinal")], [F.col("_state").alias("state"), *said("status", "observation_id", "failure")])
    seen = of("observation.accepted", "observation.retained")
    observations = seen.groupBy("campaign_id", F.col("aggregate_id").alias("attempt_id"), _field("observation_id").alias("observation_id")).agg(F.min(F.struct(order, *said("work_item_id", "object_uri"), _field("byte_size").try_cast("long").alias("byte_size"), *said("sha256", "status"))).alias("f"))
    money = ledger(events)
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0)).alias(kind)
    sums = money.groupBy("campaign_id").agg(total("adjusted_up"), total("adjusted_down"), F.min("unit").alias("unit"))
    spent = budget.usage(money, "campaign_id", F.lit(0)).drop("remaining").join(sums, "campaign_id")
    flat = lambda rows, key: rows.select(*SECTIONS[key][0], *(F.col(f"f.{c}" if c in SECTIONS[key][1] and c not in ("status", "observation_id", "failure") or key == "observations" else f"l.{c}") for c in SECTIONS[key][1] + SECTIONS[key][2]))
    out = {"campaigns": flat(campaigns, "campaigns"), "work_items": flat(items, "work_items"), "jobs": flat(jobs, "jobs"), "attempts": flat(attempts, "attempts"), "observations": flat(observations, "observations")}
    return out | {"budget": spent.select(*fields("budget"))}


def compare_sections(replayed: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """(section, campaign_id, subject, difference) over all sections that
    ``stored`` has."""
    parts = []
    for name, table in stored.items():
        key, fixed, free = SECTIONS[name]
        rows = streams.difference(replayed[name], table, key, fixed + free)
        parts.append(rows.select(F.lit(name).alias("section"), F.col("campaign_id"), F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("subject"), "difference"))
    return reduce(DataFrame.unionByName, parts)


def non_rebuildable(replayed: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """(section, campaign_id, subject, path): stored rows without a replayed
    one, and fields that never change but differ. A row that only the replay
    has can be rebuilt; observations and budgets must agree as they are."""
    found = compare_sections(replayed, stored)
    fixed = F.lit(None).cast("array<string>")
    for name, (_, names, _) in SECTIONS.items():
        fixed = F.when(F.col("section") == name, F.array(*map(F.lit, names))).otherwise(fixed)
    whole = F.col("section").isin("observations", "budget")
    path = F.when(F.col("difference") == "only_right", F.array(F.lit("extra"))).when(F.col("difference") == "only_left", F.when(whole, F.array(F.lit("absent")))).otherwise(F.array_intersect(F.split("difference", ","), fixed))
    return found.select("section", "campaign_id", "subject", F.explode(path).alias("path"))


def rebuilt(replayed: dict[str, DataFrame], stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stored tables as a replay leaves them: its rows for each campaign that
    can be rebuilt, and the stored ones, untouched, for the others."""
    refused = non_rebuildable(replayed, stored).select("campaign_id").distinct()
    return {name: replayed[name].join(refused, "campaign_id", "left_anti").unionByName(table.join(refused, "campaign_id", "left_semi")) for name, table in stored.items()}


def outcome_conflicts(parts: dict[str, DataFrame]) -> DataFrame:
    """(campaign_id, subject, rule) over a replay's sections: ends that don't
    fit together. A success needs an accepted observation of its own attempt,
    another outcome may only name one if it was suppressed or lost its lease
    and the observation wasn't accepted; an accepted work item has exactly
    one success."""
    seen = parts["observations"].select("campaign_id", "attempt_id", "observation_id", F.col("status").alias("_seen"))
    ended = parts["attempts"].where("status is not null").join(seen, ["campaign_id", "attempt_id", "observation_id"], "left")
    success, named = F.col("status") == "succeeded", F.col("observation_id").isNotNull()
    rule = (
        F.when(named & F.col("_seen").isNull(), "observation_not_recorded")
        .when(success & ~F.coalesce(F.col("_seen") == "accepted", F.lit(False)), "success_without_accepted_observation")
        .when(~success & named & ~F.col("status").isin("duplicate_suppressed", "lease_lost"), "status_may_not_name_observation")
        .when(~success & named & (F.col("_seen") == "accepted"), "accepted_observation_of_other_outcome")
    )
    attempts = ended.withColumn("rule", rule).where("rule is not null").select("campaign_id", F.col("attempt_id").cast("string").alias("subject"), "rule")
    wins = parts["attempts"].where(success).groupBy("campaign_id", F.col("work_item_id").cast("string").alias("subject")).agg(F.count("*").alias("n"))
    items = parts["work_items"].where("state = 'accepted'").select("campaign_id", F.col("work_item_id").cast("string").alias("subject")).join(wins, ["campaign_id", "subject"], "left").where("n is null or n <> 1").select("campaign_id", "subject", F.lit("accepted_without_one_success").alias("rule"))
    return attempts.unionByName(items)


def appended(stored: DataFrame, new: DataFrame, key: list[str], order: str, position: str = "sequence", expected: str | None = None) -> DataFrame:
    """New events with the positions that appending gives them: after the last
    one of their stream, in ``order``. With ``expected`` (a column of the
    stream's version that the writer saw) an event whose stream has moved on
    gets problem expected_version_mismatch and no position."""
    last = stored.groupBy(*key).agg(F.max(position).alias("_last"))
    rows = new.join(last, key, "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    problem = F.lit(None).cast("string") if expected is None else F.when(F.col(expected) != F.col("_last"), "expected_version_mismatch")
    rows = rows.withColumn("problem", problem)
    place = F.row_number().over(Window.partitionBy(*key, F.col("problem").isNull()).orderBy(order))
    return rows.withColumn(position, F.when(F.col("problem").isNull(), F.col("_last") + place).cast("long")).drop("_last")
