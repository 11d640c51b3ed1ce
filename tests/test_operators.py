from decimal import Decimal

from pyspark.sql import functions as F

from galvanite.operators import budget, evidence, experiments, jobs, metrics, profile


def test_extremum_takes_the_first_of_equals_and_rejects_short_sweeps(spark):
    rows = [("a", i, Decimal(-5 if i in (7, 9) else 1), Decimal(i)) for i in range(60)] + [("b", i, Decimal(-1), Decimal(i)) for i in range(49)] + [("c", i, Decimal(i), Decimal(i)) for i in range(50)]
    frame = spark.createDataFrame(rows, "k string, row_no int, current decimal(18,6), potential decimal(18,6)")
    found = {r.k: (r.quality_status, r.extremum_potential) for r in metrics.cathodic_extremum(frame, "k").collect()}
    assert found == {"a": ("accepted", Decimal(7)), "b": ("rejected", None), "c": ("warning", Decimal(0))}
    assert metrics.metric_rows(metrics.cathodic_extremum(frame, "k"), "k").count() == 6


def test_budget_counts_adjustments_and_open_reservations(spark):
    rows = [("c", "1", "reserved", 10, None), ("c", "2", "consumed", 8, "1"), ("c", "3", "adjusted_up", 3, "1"), ("c", "4", "reserved", 5, None), ("c", "5", "adjusted_down", 1, "1")]
    frame = spark.createDataFrame(rows, "c string, entry_id string, kind string, amount int, settles string")
    r = budget.usage(frame, "c", F.lit(12)).first()
    assert (r.reserved, r.consumed, r.released, r.outstanding, r.remaining) == (15, 10, 0, 5, 0)


def test_leases(spark):
    rows = [("j1", "w", "leased", 1, 1, 3, "2024-01-01 00:00:00"), ("j2", "w", "running", 4, 3, 3, "2024-01-01 00:00:00"), ("j3", "w", "leased", 1, 1, 3, "2025-01-01 00:00:00")]
    frame = spark.createDataFrame(rows, "job_id string, work_item_id string, state string, lease_generation int, attempt_count int, max_attempts int, t string").withColumn("lease_expires_at", F.to_timestamp("t"))
    as_of = F.lit("2024-06-01").cast("timestamp")
    found = {r.job_id: (r.state, r.lease_generation, r.quarantine_reason) for r in jobs.expired_leases(frame, as_of).collect()}
    assert found == {"j1": ("available", 2, None), "j2": ("failed_terminal", 5, "retry_cap_reached:lease_lost")}
    attempts = spark.createDataFrame([("a1", "j1", "w", "running", None), ("a2", "j2", "w", "running", "x")], "attempt_id string, job_id string, work_item_id string, state string, adapter_started_at string")
    assert {r.attempt_id: r.settlement for r in jobs.abandoned_attempts(attempts, frame, as_of).collect()} == {"a1": "released", "a2": "consumed"}


def test_commands_replay_or_conflict(spark):
    frame = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", 3, "y"), ("l", 1, "z")], "k string, at int, digest string")
    found = {(r.k, r.at): r.outcome for r in jobs.replayed_commands(frame, ["k"], "at", "digest").collect()}
    assert found == {("k", 1): "stored", ("k", 2): "replayed", ("k", 3): "conflict", ("l", 1): "stored"}


def test_lineage_must_come_from_earlier_steps(spark):
    steps = spark.createDataFrame([("g", 0, ["s"], ["a"]), ("g", 1, ["a", "c"], ["b"]), ("g", 2, ["b"], ["c"])], "graph_id string, ordinal long, inputs array<string>, outputs array<string>")
    sources = spark.createDataFrame([("g", "s")], "graph_id string, id string")
    assert [(r.ordinal, r.id) for r in evidence.unclosed(steps, sources).collect()] == [(1, "c")]


def test_severities(spark):
    rows = [("x", "a", "known", "required"), ("x", "b", "unknown", "recommended"), ("x", "c", "unavailable", "optional"), ("y", "a", "not_applicable", "recommended")]
    frame = spark.createDataFrame(rows, "k string, field_name string, state string, requirement_class string")
    found = {(r.k, r.field_name): r.severity for r in experiments.findings(frame, ("a",), "k").collect()}
    assert found == {("x", "b"): "unknown", ("x", "c"): "warning", ("y", "a"): "blocking"}
    decided = {r.k: r.decision for r in experiments.release_decision(frame, experiments.findings(frame, ("a",), "k"), "k").collect()}
    assert decided == {"x": "eligible", "y": "blocked"}


def test_line_endings_and_headers(spark):
    frame = spark.createDataFrame([("a\r\nb",), ("a\nb",), ("a\rb",), ("a\r\nb\n",), ("a",)], "t string")
    assert [r[0] for r in frame.select(profile.line_ending(F.col("t"))).collect()] == ["crlf", "lf", "cr", "mixed", "none"]
    frame = spark.createDataFrame([("Current [A/cm^2]",), ("Library",)], "t string")
    assert [tuple(r) for r in frame.select(profile.header_name(F.col("t")), profile.header_unit(F.col("t"))).collect()] == [("Current", "A/cm^2"), ("Library", None)]


def test_profile_extremes_are_source_text(spark):
    frame = spark.createDataFrame([("10", "b"), ("9.50", "a"), ("", "c"), (None, "a")], "n string, t string")
    found = {r.column_name: (r.inferred_type, r.least_value, r.most_value, r.missing) for r in profile.column_profile(frame, ["n", "t"]).collect()}
    assert found == {"n": ("decimal", "9.50", "10", 2), "t": ("text", "a", "c", 0)}
