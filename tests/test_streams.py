"""Streams in any batch split, with restarts and redelivery."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from galvanite.operators import replay
from galvanite.streaming import campaigns, leases
from galvanite.streaming.sinks import KeyedTable
from test_replay import SCHEMA, STEPS, log

EVENTS = SCHEMA + ", occurred_at string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    campaigns.with_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def timed(frame, *names):
    return frame.withColumns({n: F.to_timestamp(n) for n in names})


def whole_log():
    """Campaigns of several lengths; one with observations, a retry and an adjusted budget."""
    rows = [r for c, n in (("c", 12), ("d", 6), ("e", 9)) for r in log(*STEPS[:n], campaign=c)]
    seen = {"observation_id": "o", "work_item_id": "w", "object_uri": "u", "byte_size": "7", "sha256": "ab", "status": "accepted"}
    steps = [
        *STEPS[:3], ("budget", "b", "budget.reserved", {"entry_id": "f1", "kind": "reserved", "amount": "2.50", "unit": "h"}), ("job", "j", "job.leased", {"lease_generation": 1, "lease_owner": "x", "state": "leased", "work_item_id": "w", "max_attempts": 3}),
        ("job", "j", "job.retry_scheduled", {"lease_generation": 2, "state": "retry_scheduled", "last_failure": "boom", "work_item_id": "other"}), ("attempt", "a", "attempt.started", {"ordinal": 1, "job_id": "j"}),
        ("attempt", "a", "observation.accepted", seen), ("attempt", "a", "observation.accepted", seen | {"byte_size": "8"}), ("attempt", "a", "observation.retained", seen | {"observation_id": "p", "status": "received"}),
        ("attempt", "a", "attempt.completed", {"status": "succeeded", "observation_id": "o"}), ("budget", "b", "budget.consumed", {"entry_id": "f2", "kind": "consumed", "amount": "2.00", "unit": "h", "reservation_entry_id": "f1"}),
        ("budget", "b", "budget.reserved", {"entry_id": "f3", "kind": "reserved", "amount": "1", "unit": "h"}), ("budget", "b", "budget.reserved", {"entry_id": "f4", "kind": "reserved", "amount": "4", "unit": "h"}), ("budget", "b", "budget.released", {"entry_id": "f5", "kind": "released", "amount": "4", "unit": "h", "reservation_entry_id": "f4"}),
        ("budget", "b", "budget.adjusted", {"entry_id": "f6", "kind": "adjusted_up", "amount": "0.25", "unit": "h", "reservation_entry_id": "f1"}), ("work_item", "w", "work_item.quarantined", {"reason": "odd", "state": "quarantined"}), ("campaign", "c", "campaign.paused", {}),
    ]
    rows += log(*steps, campaign="f")
    own = []
    for r in rows:  # entries have ids of their own in each campaign
        body = json.loads(r[9])
        body |= {k: f"{r[0]}-{body[k]}" for k in ("entry_id", "reservation_entry_id") if k in body}
        own.append((*r[:9], json.dumps(body), f"2024-01-01 00:{r[4]:02d}:00.{r[4]:06d}"))
    return own


def plain(frame):
    number = lambda x: x.normalize() + 0 if isinstance(x, Decimal) else x
    return sorted(str({c: number(v) for c, v in sorted(r.asDict().items())}) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_fold_equals_the_replay(spark, tmp_path, seed):
    rows = whole_log()
    twice = rows + rows[::2] + rows[:5]
    random.Random(seed).shuffle(twice)
    files = 5
    for i in range(files):
        timed(spark.createDataFrame(twice[i::files], EVENTS), "occurred_at").coalesce(1).write.parquet(f"{tmp_path}/all/{i}")
    schema = spark.read.parquet(f"{tmp_path}/all/0").schema
    table = KeyedTable(spark, f"{tmp_path}/table", campaigns.FOLDED, ["campaign_id", "section", "key"], "applied", buckets=3)
    failures = iter([False, True, *[False] * 50])

    def sink(batch, number):
        table.upsert(batch, number)
        if next(failures):  # after the table's commit, before the stream's
            raise RuntimeError("lost")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all/*")
        query = campaigns.fold(source).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()  # goes on from the checkpoint; the lost batch comes again
    found, wanted = campaigns.sections(table.read()), replay.sections(timed(spark.createDataFrame(rows, EVENTS), "occurred_at"))
    for name in replay.SECTIONS:
        assert plain(found[name]) == plain(wanted[name]), name
    assert plain(found["observations"]) and table.read().agg(F.max("waiting")).first()[0] is not None
    assert {r.waiting for r in table.read().groupBy("campaign_id").agg(F.max_by("waiting", "applied").alias("waiting")).collect()} == {0}


def test_a_gap_holds_events_back(spark, tmp_path):
    rows = [r for r in whole_log() if r[0] == "c" and r[4] != 4]
    timed(spark.createDataFrame(rows, EVENTS), "occurred_at").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    query = campaigns.fold(source).writeStream.outputMode("update").format("memory").queryName("gap").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.table("gap").collect()
    assert {r.applied for r in found} == {3} and {r.waiting for r in found} == {8}
    assert sorted(r.section for r in found) == ["campaigns", "jobs", "work_items"]


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, at long, v string", ["k"], "at", buckets=4)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, at long, v string")
    rows = lambda: sorted(map(tuple, table.read().collect()))
    assert rows() == []
    assert table.upsert(frame(("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y")), 0)
    assert not table.upsert(frame(("a", 9, "no")), 0)
    assert rows() == [("a", 2, "y"), ("b", 1, "x")]
    monkeypatch.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):  # between the write and the commit
        table.upsert(frame(("a", 5, "z"), ("c", 1, "new")), 1)
    assert rows() == [("a", 2, "y"), ("b", 1, "x")]
    monkeypatch.undo()
    assert table.upsert(frame(("a", 5, "z"), ("c", 1, "new"), ("b", 0, "old")), 1)
    assert rows() == [("a", 5, "z"), ("b", 1, "x"), ("c", 1, "new")]
    untouched = {p: f for p, f in table.committed()["parts"].items() if f.startswith("data/0-")}
    assert table.upsert(frame(), 2) and {p: f for p, f in table.committed()["parts"].items() if f.startswith("data/0-")} == untouched
    assert table.vacuum() > 0 and rows() == [("a", 5, "z"), ("b", 1, "x"), ("c", 1, "new")] and table.vacuum() == 0


def streamed(spark, tmp_path, batches, schema, times, build, name):
    """Runs a stream of the given batches, one file each, and returns its rows."""
    for i, rows in enumerate(batches):
        timed(spark.createDataFrame(rows, schema), *times).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{i:03d}")
    source = spark.readStream.schema(timed(spark.createDataFrame([], schema), *times).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
    query = build(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}/cp").start()
    query.processAllAvailable()
    state = [s.numRowsTotal for s in query.lastProgress.stateOperators] if query.lastProgress else []
    query.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str), state


LEASES = "job_id string, lease_generation long, lease_expires_at string, ended boolean, seen_at string"
DAY = "2024-01-01 "


def lease_rows():
    row = lambda job, generation, expires, ended, seen: (job, generation, DAY + expires, ended, DAY + seen)
    return [
        row("a", 1, "00:10:00", False, "00:00:00"), row("a", 1, "00:20:00", False, "00:05:00"), row("b", 1, "00:10:00", False, "00:00:01"), row("b", 1, "00:10:00", True, "00:08:00"),
        row("b", 1, "00:30:00", False, "00:07:00"), row("c", 1, "00:05:00", False, "00:01:00"), row("c", 2, "09:00:00", False, "00:04:00"), row("c", 1, "00:06:00", True, "00:04:30"),
    ]


@pytest.mark.parametrize("split", [[8], [1] * 8, [4, 4], [2, 3, 3]])
def test_an_ended_job_never_runs_out(spark, tmp_path, split):
    rows = lease_rows()
    random.Random(len(split)).shuffle(rows)
    batches, at = [], 0
    for n in split:
        batches.append(rows[at : at + n])
        at += n
    batches += [[("d", 1, DAY + "01:00:00", False, DAY + "02:00:00")], [("z", 1, DAY + "23:00:00", True, DAY + "03:00:00")]]
    found, _ = streamed(spark, tmp_path, batches, LEASES, ["lease_expires_at", "seen_at"], lambda s: leases.expirations(s, "seen_at", "15 minutes"), f"ran_{len(split)}")
    assert [(j, g, str(e)[11:16]) for j, g, e in found] == [("a", 1, "00:20"), ("d", 1, "01:00")]


def test_a_lease_that_ran_out_stays_so_until_it_is_forgotten(spark, tmp_path):
    row = lambda job, generation, expires, seen, ended=False: (job, generation, DAY + expires, ended, DAY + seen)
    batches = [[row("a", 2, "00:10:00", "00:00:00")], [row("tick", 9, "23:59:00", "01:00:00", True)], [row("a", 2, "02:00:00", "01:01:00"), row("a", 1, "02:00:00", "01:01:00")], [row("tick", 9, "23:59:00", "04:00:00", True)], [row("a", 3, "04:10:00", "04:01:00")], [row("tick", 9, "23:59:00", "06:00:00", True)]]
    found, _ = streamed(spark, tmp_path, batches, LEASES, ["lease_expires_at", "seen_at"], lambda s: leases.expirations(s, "seen_at", "1 minute", forget="1 day"), "stays")
    assert [(j, g) for j, g, _ in found] == [("a", 2), ("a", 3)]
    ticks = [[row(f"j{i}", 1, "00:10:00", "00:00:00", True) for i in range(20)], [row("tick", 1, "09:00:00", "05:00:00")], [row("tick", 1, "09:00:00", "05:01:00")]]
    _, state = streamed(spark, tmp_path, ticks, LEASES, ["lease_expires_at", "seen_at"], lambda s: leases.expirations(s, "seen_at", "1 minute", forget="1 hour"), "forgets")
    assert 0 < state[0] < 10  # the twenty ended jobs are gone


RESULTS = "job_id string, event_id string, lease_generation long, kind string, at string"


@pytest.mark.parametrize("split", [[9], [1] * 9, [3, 3, 3]])
def test_results_are_judged_by_event_time(spark, tmp_path, split):
    row = lambda job, event, generation, kind, minute: (job, event, generation, kind, f"2024-01-01 00:{minute:02d}:00")
    rows = [row("a", "1", 1, "lease", 0), row("a", "2", 2, "lease", 5), row("a", "3", 1, "result", 6), row("a", "4", 2, "result", 7), row("a", "5", 2, "result", 8), row("b", "6", 0, "result", 1), row("c", "7", 1, "lease", 1), row("c", "8", 1, "result", 2), row("c", "9", 2, "lease", 3)]
    random.Random(sum(split) + len(split)).shuffle(rows)
    batches, at = [], 0
    for n in split:
        batches.append(rows[at : at + n])
        at += n
    batches += [[row("tick", "t", 1, "lease", 59)], [row("tick", "u", 1, "lease", 59)]]
    found, _ = streamed(spark, tmp_path, batches, RESULTS, ["at"], lambda s: leases.judged_results(s, "at", "20 minutes"), f"judged_{len(split)}")
    assert sorted((e, s) for _, e, _, s in found) == [("3", "received"), ("4", "accepted"), ("5", "duplicate_suppressed"), ("6", "accepted"), ("8", "accepted")]


class _Kept(dict):
    """A state that counts what it is asked."""

    def __init__(self):
        super().__init__()
        self.reads = self.writes = 0

    def get(self):
        return super().get("v")

    def update(self, value):
        self["v"] = value

    def containsKey(self, key):
        self.reads += 1
        return key in self

    def getValue(self, key):
        self.reads += 1
        return self[key]

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.writes += 1
        del self[key]


def _folded(monkeypatch, batches, cached=10_000):
    monkeypatch.setattr(campaigns, "CACHED", cached)
    states = {}
    make = lambda name, *_: states.setdefault(name, _Kept())
    fold = campaigns.CampaignFold()
    fold.init(type("Handle", (), {"getValueState": staticmethod(make), "getMapState": staticmethod(make)}))
    newest = {}
    for rows in batches:
        for r in fold.handleInputRows(("1",), iter(rows), None):
            newest[r.section, r.key] = (r.applied, r.waiting, json.loads(r.body))
    return newest, states


def test_a_batch_asks_the_state_for_what_it_does_not_hold(monkeypatch):
    entry = lambda **x: json.dumps({"entry": None, "kind": None, "amount": None, "unit": "h", "settles": None} | x)
    events = []
    for n in range(1, 301):
        if n % 3 == 0:
            said = ("budget", "[]", entry(entry=f"e{n}", kind="reserved", amount=str(n)))
        elif n % 3 == 1:
            said = ("budget", "[]", entry(entry=f"c{n}", kind="consumed", amount="1", settles=f"e{n - 1 if n % 2 else n + 2}"))  # some settle what comes later
        else:
            said = ("jobs", f'["{n % 7}"]', json.dumps({"first": {"a": n}, "last": {"b": n}}))
        events.append({"campaign_position": n, "event_id": str(n), "section": said[0], "key": said[1], "body": said[2]})
    shuffled = random.Random(5).sample(events, len(events))
    plain, _ = _folded(monkeypatch, [[e] for e in events])  # in order, each by itself
    whole, states = _folded(monkeypatch, [shuffled + shuffled[:50]])
    bodies = lambda found: {k: v[2] for k, v in found.items()}
    assert bodies(whole) == bodies(plain)
    assert states["next"].get() == (301, 0) and all(v[:2] == (300, 0) for v in whole.values())
    assert not states["held"] and states["held"].reads + states["held"].writes == 0
    assert sum(states[n].reads for n in ("rows", "open", "settled")) == 0
    assert states["rows"].writes == 8
    for cached in (1, 4, 37):  # little room: held events and reservations go to the state and come back
        for cuts in (1, 2, 9):
            found, states = _folded(monkeypatch, [shuffled[k::cuts] for k in range(cuts)], cached)
            assert bodies(found) == bodies(plain) and not states["held"] and states["next"].get() == (301, 0)
