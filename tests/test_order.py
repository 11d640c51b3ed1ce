"""Lineage graphs, ordinals of one long stream, and settlements, each against plain loops."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from galvanite.operators import lineage, ordinals, settlement


def plain_depths(edges, records):
    parents = {}
    for c, p in edges:
        if c is not None and p is not None:
            parents.setdefault(c, set()).add(p)

    def reach(r):
        seen, todo = set(), [r]
        while todo:
            for p in parents.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    all_reach = {r: reach(r) for r in {*parents, *records, *(p for ps in parents.values() for p in ps)}}
    cyclic = {r for r, s in all_reach.items() if r in s}
    memo = {}

    def depth(r):
        if r not in memo:
            memo[r] = max((depth(p) + 1 for p in parents.get(r, ())), default=0)
        return memo[r]

    out = {}
    for r in records:
        problem = "cycle" if r in cyclic else "comes_from_cycle" if all_reach[r] & cyclic else None
        out[r] = (None if problem else depth(r), len(all_reach[r]), problem)
    return out


def test_depths_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, rng.randrange(i)) for i in range(1, 60) for _ in range(2)] + [(200, 201), (201, 202), (202, 200), (203, 201), (204, 204), (205, 203), (None, 1), (1, None), (5, 900)]
    edges += [(1000 + i, 999 + i) for i in range(1, 40)]
    records = [*range(60), *range(200, 206), *range(1000, 1040), 5000]
    frame = spark.createDataFrame(edges + edges[:9], "child long, parent long")
    found = {r.record: (r.depth, r.n_ancestors, r.problem) for r in lineage.depths(frame, spark.createDataFrame([(r,) for r in records], "record long")).collect()}
    assert found == plain_depths(edges, records)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    rounds = []
    keep = lineage.kept
    monkeypatch.setattr(lineage, "kept", lambda df: rounds.append(1) or keep(df))
    frame = spark.createDataFrame([(i, i - 1) for i in range(1, 257)], "child long, parent long")
    found = lineage.ancestors(frame).where("record = 256").agg(F.max("distance"), F.count("*")).first()
    assert tuple(found) == (256, 256) and len(rounds) <= 11


def test_depths_shuffle_fewer_rows_than_there_are_pairs(spark):
    """Once each round shuffled all pairs and joined them to each other."""
    store = spark.sparkContext._jsc.sc().statusStore()
    records = spark.range(1, 6000).select(F.col("id").alias("record"))
    halves = records.select(F.col("record").alias("child"), F.explode(F.array(F.floor(F.col("record") / 2), F.floor(F.col("record") / 3))).alias("parent")).where("parent > 0")
    before = max((s.stageId() for s in stages(store)), default=-1)
    found = lineage.depths(halves, records).agg(F.sum("n_ancestors"), F.max("depth")).first()
    shuffled = sum(s.shuffleReadRecords() for s in stages(store) if s.stageId() > before)
    parents = [(), ()] + [tuple({i // 2, i // 3} - {0}) for i in range(2, 6000)]
    reach, depth = [set(), set()], [0, 0]
    for ps in parents[2:]:
        reach.append({*ps}.union(*(reach[q] for q in ps)))
        depth.append(1 + max(depth[q] for q in ps))
    assert tuple(found) == (sum(map(len, reach)), max(depth))
    assert shuffled < found[0]


def stages(store):
    out, k = [], 0
    found = store.stageList(None, False, False, doubles(), None)
    while k < found.size():
        out.append(found.apply(k))
        k += 1
    return out


def doubles():
    from pyspark import SparkContext

    return SparkContext._gateway.new_array(SparkContext._jvm.double, 0)


def test_lost_sources(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "x"), ("y", "x")], "child string, parent string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(map(tuple, lineage.open_records(edges, ids("a"), ids("b", "c", "y")).collect())) == [("c", "x"), ("y", "x")]
    assert lineage.open_records(edges, ids("a", "x"), ids("b", "c", "y")).count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_ordinals_equal_a_window(spark, ranges):
    rng = random.Random(2)
    rows = [("one", rng.randrange(10_000), i) for i in range(3000)] + [(None, rng.randrange(50), i) for i in range(3000, 3100)] + [(f"k{i}", i, 4000 + i) for i in range(50)] + [("two", 5, 5000), ("two", None, 5001)]
    frame = spark.createDataFrame(rows, "k string, at long, id long")
    found = {r.id: (r.ordinal, r.previous_id, r.previous_at) for r in ordinals.numbered(frame, ["k"], ["at", "id"], previous=["id", "at"], ranges=ranges).collect()}
    wanted = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for n, (before, r) in enumerate(zip([(None, None, None), *own], own, strict=False), 1):
            wanted[r[2]] = (n, before[2], before[1])
    assert found == wanted
    assert ordinals.numbered(frame.limit(0), ["k"], ["at"]).columns == ["k", "at", "id", "ordinal"]


def test_one_long_stream_is_many_tasks(spark):
    frame = spark.range(20_000).select(F.lit("one").alias("k"), (F.col("id") + F.when(F.col("id") >= 12_345, 1).otherwise(0) + 1).alias("position"))
    sizes = [r["count"] for r in ordinals.ranged(frame, ["k"], ["position"], ranges=8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    gaps = ordinals.position_gaps(frame, ["k"], "position", ranges=8)
    assert (gaps.count(), gaps.agg(F.min("position")).first()[0]) == (20_000 - 12_345, 12_347)


def plain_settlements(rows, limit, estimate):
    """The instructions of one campaign, one after the other."""
    active, committed, held, out = True, Decimal(0), {}, []
    for position, instruction, reservation, attempt, actual in rows:
        entry = amount = problem = None
        exhausts = False
        own = held.get(reservation)
        if instruction == "reserve":
            if own is not None:
                problem = "repeated"
            elif not active:
                problem = "refused"
                held.setdefault(reservation, None)
            elif committed + estimate > limit:
                problem, exhausts, active = "refused", True, False
            else:
                entry, amount, committed = "reserved", estimate, committed + estimate
                held[reservation] = {"kind": None}
        elif own is None:
            problem = "no_reservation"
        elif own["kind"] is None:
            amount = estimate if instruction == "release" or actual is None else actual
            if amount <= 0:
                problem, amount = "amount_not_positive", None
            else:
                own |= {"kind": instruction, "attempt": attempt, "recorded": amount, "adjusted": False}
                entry = "consumed" if instruction == "consume" else "released"
                committed += (amount if instruction == "consume" else 0) - estimate
                exhausts = instruction == "consume" and amount > estimate
        elif instruction == "consume" and own["kind"] == "consume" and own["attempt"] == attempt:
            asked = actual or own["recorded"]
            if asked == own["recorded"]:
                problem = "repeated"
            elif own["adjusted"]:
                problem = "reservation_settled"
            else:
                entry, amount = ("adjusted_up" if asked > own["recorded"] else "adjusted_down"), abs(asked - own["recorded"])
                committed += asked - own["recorded"]
                own |= {"recorded": asked, "adjusted": True}
                exhausts = asked > estimate
        else:
            problem = "reservation_settled"
        active = active and not exhausts
        out.append((position, entry, amount, problem, exhausts))
    return out


def test_settlements_against_a_loop(spark):
    rng = random.Random(5)
    campaigns = {}
    for c in range(120):
        rows, names = [], [f"r{k}" for k in range(6)]
        for position in range(1, 26):
            instruction = rng.choice(["reserve", "reserve", "consume", "consume", "release"])
            actual = rng.choice([None, Decimal(5), Decimal(7), Decimal(9), Decimal(10), Decimal(0), Decimal(-1)] + [Decimal(11)] * (c % 3 == 0))
            rows.append((position, instruction, rng.choice(names), rng.choice(["a", "b", None]), actual))
        seen, own = set(), []
        for r in rows:  # a reservation is requested once
            if r[1] != "reserve" or r[2] not in seen:
                own.append(r)
                seen |= {r[2]} if r[1] == "reserve" else set()
        campaigns[c] = own
    frame = spark.createDataFrame([(c, *r) for c, rows in campaigns.items() for r in rows], "campaign_id long, position long, instruction string, reservation_id string, attempt_id string, actual decimal(28,9)")
    found = settlement.settled(frame, F.lit(35), F.lit(10)).collect()
    by = {}
    for r in found:
        by.setdefault(r.campaign_id, []).append((r.position, r.entry, r.amount, r.problem, r.exhausts))
    kinds = set()
    for c, rows in campaigns.items():
        wanted = plain_settlements(rows, Decimal(35), Decimal(10))
        assert sorted(by[c]) == wanted, (c, [(a, b) for a, b in zip(sorted(by[c]), wanted, strict=True) if a != b])
        kinds |= {x for _, e, _, p, _ in wanted for x in (e, p)}
    assert kinds >= {"reserved", "consumed", "released", "adjusted_up", "adjusted_down", "refused", "no_reservation", "amount_not_positive", "reservation_settled", "repeated"}
