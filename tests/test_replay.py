import json

from pyspark.sql import functions as F

from galvanite.operators import replay
from galvanite.streaming import folds, liveness

SCHEMA = "campaign_id string, aggregate_type string, aggregate_id string, sequence long, campaign_position long, event_id string, event_type string, causation_id string, correlation_id string, payload string"


def log(*steps, campaign="c"):
    """Events from (aggregate type, id, event type, payload)."""
    seen, out = {}, []
    for at, (kind, name, event, payload) in enumerate(steps, 1):
        seen[kind, name] = n = seen.get((kind, name), 0) + 1
        out.append((campaign, kind, name, n, at, f"{campaign}{at}", event, f"{campaign}{at - 1}" if at > 1 else None, "k", json.dumps(payload)))
    return out


STEPS = [
    ("campaign", "c", "campaign.created", {"state": "active"}),
    ("work_item", "w", "work_item.queued", {}),
    ("job", "j", "job.enqueued", {}),
    ("budget", "b", "budget.reserved", {"entry_id": "r1", "kind": "reserved", "amount": "2.50", "unit": "h"}),
    ("job", "j", "job.leased", {"lease_generation": 1}),
    ("job", "j", "job.started", {"lease_generation": 1}),
    ("attempt", "a", "attempt.started", {}),
    ("attempt", "a", "attempt.completed", {"status": "succeeded"}),
    ("budget", "b", "budget.consumed", {"entry_id": "r2", "kind": "consumed", "amount": "2.50", "unit": "h", "reservation_entry_id": "r1"}),
    ("job", "j", "job.succeeded", {}),
    ("work_item", "w", "work_item.accepted", {}),
    ("campaign", "c", "campaign.completed", {}),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_sound_campaign(spark):
    events = frame(spark, log(*STEPS))
    assert replay.first_violations(events).collect() == []
    states = {r.aggregate_type: r.state for r in replay.projections(events).collect()}
    assert states == {"campaign": "completed", "work_item": "accepted", "job": "succeeded", "attempt": "succeeded"}
    sums = replay.totals(events, F.lit(10)).first()
    assert (float(sums.reserved), float(sums.consumed), float(sums.outstanding), float(sums.remaining)) == (2.5, 2.5, 0, 7.5)
    assert replay.terminal_conflicts(replay.projections(events)).collect() == []


def broken(spark, rows):
    found = replay.first_violations(frame(spark, rows)).collect()
    return found[0].rule if found else None


def test_each_break_is_seen(spark):
    rows = log(*STEPS)
    assert broken(spark, rows[:4] + rows[5:]) == "campaign_position_gap"
    other = [list(r) for r in rows]
    other[5][3] = 9
    assert broken(spark, [tuple(r) for r in other]) == "aggregate_sequence_gap"
    other = [list(r) for r in rows]
    other[3][7] = "c9"
    assert broken(spark, [tuple(r) for r in other]) == "invalid_event_causation"
    assert broken(spark, log(*STEPS[:3], ("job", "j", "job.succeeded", {}))) == "illegal_transition"
    assert broken(spark, log(*STEPS[:6], ("job", "j", "job.heartbeat", {"lease_generation": 0}))) == "lease_generation_fell"
    assert broken(spark, log(*STEPS[:9], STEPS[8])) == "reservation_settled_twice"
    assert broken(spark, log(*STEPS[:4], ("budget", "b", "budget.adjusted", {"entry_id": "x", "kind": "adjusted_up", "amount": "1", "reservation_entry_id": "r1"}))) == "adjustment_without_consumption"
    assert broken(spark, log(STEPS[0], ("job", "j", "job.exploded", {}))) == "unknown_event_type"


def test_open_attempt_of_a_finished_campaign(spark):
    events = frame(spark, log(*STEPS[:7], STEPS[11]))
    assert [r.rule for r in replay.terminal_conflicts(replay.projections(events)).collect()] == ["open_attempt"]


def test_comparison_names_what_differs(spark):
    state = replay.projections(frame(spark, log(*STEPS)))
    stored = state.withColumn("state", F.when(F.col("aggregate_type") == "job", "running").otherwise(F.col("state"))).where("aggregate_type <> 'attempt'")
    assert {(r.aggregate_type, r.difference) for r in replay.compare(state, stored).collect()} == {("job", "state"), ("attempt", "only_left")}


def test_stream_fold_equals_batch(spark, tmp_path):
    events = frame(spark, log(*STEPS) + log(*STEPS[:6], campaign="d"))
    replay.state_events(events).select("campaign_id", "aggregate_type", "aggregate_id", "sequence", "state").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("campaign_id string, aggregate_type string, aggregate_id string, sequence long, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = folds.fold_states(source).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    key = ["campaign_id", "aggregate_type", "aggregate_id"]
    last = spark.table("folded").groupBy(*key).agg(F.max(F.struct("sequence", "state")).alias("m")).select(*key, "m.sequence", "m.state")
    wanted = replay.projections(events).select(*key, "sequence", "state")
    assert sorted(last.collect()) == sorted(wanted.collect())


def test_redelivery_and_liveness_on_streams(spark, tmp_path):
    rows = [("j", f"2024-01-01 00:0{m}:00") for m in (0, 1, 1, 2)] + [("j", "2024-01-01 03:00:00"), ("j", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "job string, at string").select("job", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("job string, at timestamp").parquet(str(tmp_path / "in"))
    once = folds.once(source, ["job", "at"], "at", "1 day")
    query = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "a")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == 5
    batch = liveness.liveness(spark.read.parquet(str(tmp_path / "in")), "job", "at", "1 hour")
    assert [r.n_beats for r in batch.orderBy("started").collect()] == [4, 1, 1]
    kept, late = liveness.split_late(spark.read.parquet(str(tmp_path / "in")), "at", "2024-01-01 01:00:00")
    assert (kept.count(), late.count()) == (2, 4)
