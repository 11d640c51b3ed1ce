import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from galvanite.llm.conversation_trie import encoded, multikey_quicksort, prefix_trie, with_heads
from galvanite.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    """Nodes of a dict of conv_id -> list of (role, text), from the definition."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(p))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turns_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in own.items()}


def rebuilt(own):
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    return whole


def nodes(frame):
    assert frame.columns == NAMES
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("limit", [None, 1, 7, 100_000])
def test_against_all_prefixes(spark, limit):
    rng = random.Random(2)
    own = {}
    for c in range(260):
        own[c] = [("user", f"t{rng.randrange(2)}") for _ in range(rng.randrange(9))]
    own |= {1000 + i: [("user", "hot")] * 40 + [("assistant", "x" * i)] * (i % 3) for i in range(90)}  # a long common prefix
    own |= {2000 + i: [("user", "copy"), ("assistant", "copy")] for i in range(150)}
    rows = [(c, k, r, t) for c, turns in own.items() for k, (r, t) in enumerate(turns)]
    own = {c: t for c, t in own.items() if t}
    assert nodes(prefix_trie(encoded(spark.createDataFrame(rows, SCHEMA).repartition(5)), limit=limit)) == brute(own)


def test_conversations_begin_with_their_hundreds(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, k, "user" if k % 2 else "assistant", f"text {rng.randrange(3)} ünï") for c in [*range(0, 330), *range(-40, 0), 1005, 10_007] for k in range(rng.randrange(1, 9))]
    rows += [(5, None, None, None), (5, None, "user", "b"), (5, 0, "user", "b"), (6, 1, "user", "tie"), (6, 1, "user", "tie"), (None, 0, "user", "lost"), (7777, 0, "user", "x" * 300_000)]
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA + ", depth int, ids string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    found = nodes(op12_conversation_trie(spark, str(tmp_path)))
    assert found == brute(rebuilt(turns_of(rows)))
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in found)  # some are left without turns
    frame.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert nodes(op12_conversation_trie(spark, f"{tmp_path}/none")) == []


def test_one_sequence_holds_a_third_of_all(spark):
    own = {c: [("user", "hot"), ("assistant", "same")] if c % 3 == 0 else [("user", "hot"), ("assistant", f"a{c}")] for c in range(3000)}
    rows = [(c, k, r, t) for c, turns in own.items() for k, (r, t) in enumerate(turns)]
    assert nodes(prefix_trie(encoded(spark.createDataFrame(rows, SCHEMA).repartition(6)), limit=50)) == brute(own)


def test_heads_of_absent_and_short_conversations(spark):
    from pyspark.sql import functions as F

    own = spark.createDataFrame([(0, [1, 2], [5, 5]), (3, [7, 8, 9], [1, 1, 1]), (201, [4], [1])], "conv_id long, ids array<long>, sizes array<int>")
    found = {r.conv_id: (r.ids, r.sizes) for r in with_heads(own, F.when(F.col("conv_id") == 3, 1).otherwise(3), 100, 5).collect()}
    assert found == {0: ([1, 2], [5, 5]), 3: ([1, 8, 9], [5, 1, 1]), 201: ([], [])}


def test_quicksort_of_one_very_long_sequence():
    long = list(range(50_000))
    out = multikey_quicksort([(1, 1, long, long, "a"), (2, 1, [*long, 1], [*long, 1], "b")], 0)
    assert len(out.parent) == 50_002 and out.ends[-2:] == ["a", "b"]
