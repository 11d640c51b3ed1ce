"""The campaign fold on a stream: six sections, kept as state of a campaign.

Events may come shuffled over batches and repeat. They are applied in the
order of their positions: one that comes early is held until the gap before it
closes, one whose position was applied already changes nothing. What an event
says is made in the JVM (``patches``); the processor only merges fields."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from galvanite.operators import replay

PATCH = ["campaign_id", "campaign_position", "event_id", "section", "key", "body"]
FOLDED = "campaign_id string, section string, key string, applied long, waiting long, body string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a campaign, early events and reservations that are kept in memory before they go to the state.
CACHED = 10_000


def with_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed list and map state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _object(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.cast("string").alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def patches(events: DataFrame) -> DataFrame:
    """What each event says about one row of one section: PATCH, where key is
    a JSON list and body a JSON object with ``first`` (counts once), ``last``
    (the newest counts) or, in the budget, an entry. Events that say nothing
    have no section; their positions count all the same. Timestamps are
    microseconds."""
    field, state, at = replay._field, F.col("_state"), F.unix_micros(F.col("occurred_at").cast("timestamp"))  # noqa: SLF001
    said = lambda *names: {n: field(n) for n in names}
    whole = lambda *names: {n: field(n).try_cast("long") for n in names}
    kind, own = F.col("aggregate_type"), F.col("aggregate_id")
    seen = F.col("event_type").isin("observation.accepted", "observation.retained")
    tries = F.col("event_type").isin("attempt.started", "attempt.completed")
    moved = state.isNotNull()
    parts = [
        ("observations", seen, [own, field("observation_id")], said("work_item_id", "object_uri") | whole("byte_size") | said("sha256", "status"), {}),
        ("attempts", tries, [own], said("work_item_id", "job_id") | whole("ordinal"), {"state": state} | said("status", "observation_id", "failure")),
        ("campaigns", (kind == "campaign") & moved, [], said("name", "environment_id") | {"created_at": at}, {"state": state, "updated_at": at}),
        ("work_items", (kind == "work_item") & moved, [own], said("candidate_id") | {"created_at": at}, {"state": state, "quarantine_reason": F.when(state == "quarantined", field("reason")), "updated_at": at}),
        ("jobs", kind == "job", [own], said("work_item_id") | whole("max_attempts") | said("command_version", "idempotency_key"), {"state": field("state")} | said("lease_owner", "lease_expires_at") | whole("lease_generation", "attempt_count") | said("last_failure") | {"last_event_id": F.col("event_id")}),
    ]
    money = F.col("event_type").startswith("budget.")
    amount = field("amount").try_cast("decimal(38,18)")
    section, key = F.when(money, "budget"), F.when(money, F.lit("[]"))
    body = F.when(money, _object(entry=field("entry_id"), kind=field("kind"), amount=amount, unit=field("unit"), settles=field("reservation_entry_id")))
    nothing = F.lit("{}")
    for name, condition, keys, first, last in parts:
        section, key = section.when(condition, name), key.when(condition, F.to_json(F.array(*(k.cast("string") for k in keys))) if keys else F.lit("[]"))
        body = body.when(condition, F.concat(F.lit('{"first":'), _object(**first) if first else nothing, F.lit(',"last":'), _object(**last) if last else nothing, F.lit("}")))
    rows = events.withColumn("_state", replay._state())  # noqa: SLF001
    return rows.select(F.col("campaign_id").cast("string").alias("campaign_id"), F.col("campaign_position").cast("long").alias("campaign_position"), F.col("event_id").cast("string").alias("event_id"), section.alias("section"), key.alias("key"), body.alias("body"))


class CampaignFold(StatefulProcessor):
    """State of a campaign: the next position, events held for a gap, the
    rows of its sections, and its open and settled reservations."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "position long, waiting long")
        self.held = handle.getMapState("held", "position long", "event_id string, section string, key string, body string")
        self.rows = handle.getMapState("rows", "section string, key string", "body string")
        self.open = handle.getMapState("open", "entry string", "amount string")
        self.settled = handle.getMapState("settled", "entry string", "yes boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        """Each call to the state is a message to the JVM: what a batch itself
        brings stays in memory, up to ``CACHED`` of a kind, and a campaign
        without state is asked nothing."""
        kept = self.next.get()
        position, stored = (kept[0], kept[1]) if kept else (1, 0)
        self.known = {name: bool(kept) for name in ("rows", "open", "settled")}  # whether the state may hold some of these
        self.opened, self.closed = {}, set()
        early: dict[int, tuple] = {}
        changed: dict[tuple[str, str], dict] = {}
        for row in rows:
            at = row["campaign_position"]
            if at is None or at < position:
                continue
            said = (row["event_id"], row["section"], row["key"], row["body"])
            if at > position:
                if at not in early and not (stored and self.held.containsKey((at,))):
                    if len(early) < CACHED:
                        early[at] = said
                    else:
                        self.held.updateValue((at,), said)
                        stored += 1
                continue
            while said:
                self._apply(changed, *said[1:])
                position += 1
                said = early.pop(position, None)
                if said is None and stored and self.held.containsKey((position,)):
                    said = self.held.getValue((position,))
                    self.held.removeKey((position,))
                    stored -= 1
                if len(changed) >= CACHED:
                    yield from self._given(key[0], changed, position - 1, len(early) + stored + (said is not None))
        for at, said in early.items():
            self.held.updateValue((at,), said)
        waiting = stored + len(early)
        self.next.update((position, waiting))
        self._entries_stored()
        yield from self._given(key[0], changed, position - 1, waiting)

    def _given(self, campaign: str, changed: dict, applied: int, waiting: int) -> Iterator[Row]:
        self.known["rows"] = self.known["rows"] or bool(changed)
        for (section, key), body in changed.items():
            text = json.dumps(body)
            self.rows.updateValue((section, key), (text,))
            yield Row(campaign_id=campaign, section=section, key=key, applied=applied, waiting=waiting, body=text)
        changed.clear()

    def _entries_stored(self) -> None:
        """Moves the reservations that a batch opened or settled to the state."""
        for entry, amount in self.opened.items():
            self.open.updateValue((entry,), (amount,))
        for entry in self.closed:
            self.settled.updateValue((entry,), (True,))
        self.known["open"], self.known["settled"] = self.known["open"] or bool(self.opened), self.known["settled"] or bool(self.closed)
        self.opened, self.closed = {}, set()

    def _is_settled(self, entry: str) -> bool:
        return entry in self.closed or (self.known["settled"] and self.settled.containsKey((entry,)))

    def _taken(self, entry: str) -> str | None:
        """The amount of an open reservation, which is open no more."""
        amount = self.opened.pop(entry, None)
        if self.known["open"] and self.open.containsKey((entry,)):
            amount = amount or self.open.getValue((entry,))[0]
            self.open.removeKey((entry,))
        return amount

    def _apply(self, changed: dict, section: str | None, key: str | None, body: str | None) -> None:
        if section is None or body is None:
            return
        name = (section, key or "[]")
        now = changed.get(name)
        if now is None:
            now = json.loads(self.rows.getValue(name)[0]) if self.known["rows"] and self.rows.containsKey(name) else None
        said = json.loads(body)
        if section == "budget":
            changed[name] = self._entered(now or dict.fromkeys(("reserved", "consumed", "released", "adjusted_up", "adjusted_down", "outstanding"), "0"), said)
        else:
            changed[name] = (now or said["first"]) | said["last"]

    def _entered(self, sums: dict, entry: dict) -> dict:
        """The budget after one more ledger entry. What is consumed counts
        adjustments; what is outstanding is reserved and not settled."""
        add = lambda name, amount: sums.__setitem__(name, str(Decimal(sums[name]) + amount))
        kind, amount = entry["kind"], Decimal(entry["amount"] or 0)
        if entry["unit"] is not None:
            sums["unit"] = min(sums.get("unit") or entry["unit"], entry["unit"])
        if kind in ("reserved", "consumed", "released", "adjusted_up", "adjusted_down"):
            add(kind, amount)
        if kind in ("adjusted_up", "adjusted_down"):
            add("consumed", amount if kind == "adjusted_up" else -amount)
        if kind == "reserved" and not (entry["entry"] and self._is_settled(entry["entry"])):
            add("outstanding", amount)
            if entry["entry"]:
                self.opened[entry["entry"]] = str(amount)
        settles = entry["settles"]
        if kind in ("consumed", "released") and settles and not self._is_settled(settles):
            self.closed.add(settles)
            taken = self._taken(settles)
            if taken is not None:
                add("outstanding", -Decimal(taken))
        if len(self.opened) + len(self.closed) >= CACHED:
            self._entries_stored()
        return sums


def fold(events: DataFrame) -> DataFrame:
    """A stream of campaign events to the rows that each batch changes
    (update mode): campaign_id, section, key, applied (the last position that
    was applied), waiting (events held for a gap) and body, the row's fields.

    Events as for ``replay.sections``. Within a campaign, positions count from
    1 and reservations have ids of their own. State grows with the rows of a
    campaign's sections, as the tables do, and with what a gap holds back; a
    batch keeps at most ``CACHED`` of a kind in memory."""
    return patches(events).groupBy("campaign_id").transformWithState(CampaignFold(), FOLDED, "Update", "None")


def sections(folded: DataFrame) -> dict[str, DataFrame]:
    """The six tables of ``replay.sections``, from the newest row of each key
    that ``fold`` gave."""
    newest = folded.groupBy("campaign_id", "section", "key").agg(F.max_by("body", "applied").alias("body"))
    fields = newest.select("campaign_id", "section", F.from_json("key", "array<string>").alias("k"), F.from_json("body", "map<string,string>").alias("b"))
    out = {}
    for name, (keys, fixed, free) in replay.SECTIONS.items():
        own = [F.col("k")[i].alias(k) for i, k in enumerate(keys[1:])]
        out[name] = fields.where(F.col("section") == name).select("campaign_id", *own, *(_typed(name, c).alias(c) for c in fixed + free))
    return out


def _typed(section: str, name: str) -> Column:
    said = F.col("b")[name]
    if name in ("created_at", "updated_at"):
        return F.timestamp_micros(said.cast("long"))
    if name in ("byte_size", "ordinal", "max_attempts", "lease_generation", "attempt_count"):
        return said.cast("long")
    return said.cast("decimal(38,18)") if section == "budget" and name != "unit" else said
