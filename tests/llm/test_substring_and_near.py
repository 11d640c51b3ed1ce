from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvanite.llm import substring_dedup as sub
from galvanite.llm.components import components
from galvanite.llm.near_dedup import bands_for, linked, near_dedup, shingles, signatures

SCHEMA = "doc_id long, text string"


def cut(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = (t or "").encode().split()
        drop = set()
        for s in range(len(words) - window + 1):
            own = tuple(words[s : s + window])
            if own in seen:
                drop.update(range(s, s + window))
            seen.add(own)
        out[i] = (len(words), len(drop), [w for j, w in enumerate(words) if j not in drop])
    return out


def checked(spark, rows, **more):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", start string")
    wanted = cut(rows, more.get("window", 20))
    found = sub.substring_dedup(frame, **more).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_removed, (r.text or "").encode().split()) == wanted[r.doc_id]
    return found


@pytest.mark.parametrize("held", [40, 3_000_000])
def test_windows_against_brute_force(spark, held):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    passage = " ".join(rng.choice(words, 30))
    rows = [(int(i), " ".join([*rng.choice(words, rng.integers(0, 40)), *([passage] if i % 3 == 0 else []), *rng.choice(words, 5)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a " * 300), (103, "a\tb\nc\x0bd"), (None, passage), (104, passage), (105, "é " + passage)]
    checked(spark, rows, window=6, held=held)
    checked(spark, rows, window=6, held=held, common=2)  # most word groups are common
    checked(spark, rows, held=held)


def test_repeated_rows_and_untouched_text(spark):
    text = "  ".join(f"v{i}" for i in range(25))
    frame = spark.createDataFrame([(1, text), (1, text)], SCHEMA)
    found = sub.substring_dedup(frame).collect()
    assert sorted(r.n_removed for r in found) == [0, 25]
    assert text in [r.text for r in found]


def test_shared_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(sub, "rolling", lambda codes, width: np.zeros(len(codes) - width + 1, np.uint64))
    codes = np.array([1, 2, 3, 1, 2, 9, 1, 2, 3])
    order, same = sub.equal_to_previous(codes, np.arange(7), 3)
    assert sorted((int(order[i]), int(order[i + 1])) for i in np.flatnonzero(same)) == [(0, 6)]


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert sub.substring_dedup(frame).count() == 0
    assert near_dedup(frame).count() == 0


def graph(rows, words, percent):
    sets = {i: {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if (w := (t or "").encode().lower().split()) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent", "block", "most"), [(3, 85, 1024, 1 << 20), (5, 80, 4, 1 << 20), (3, 85, 1024, 500)])
def test_near_groups_against_brute_force(spark, words, percent, block, most):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(40):  # a family around one base, copies apart from each other
        own = list(base)
        for k in rng.integers(0, 120, i % 5):
            own[k] = f"x{i}{k}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"w{k}" for k in rng.integers(0, 5000, 60))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "One"), (203, "one"), (204, "one two"), (205, "THE the " * 400), (206, "the " * 700)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", size int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(frame, words=words, percent=percent, block=block, most=most).collect()}
    assert found == graph(rows, words, percent)


@pytest.mark.parametrize(("block", "most"), [(4, 1 << 20), (1000, 200)])
def test_texts_that_share_bands_and_little_else(spark, block, most):
    """Bands of one coordinate: everything meets at few hubs, and links across chunks must still be found."""
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join([*common, *(f"w{k}" for k in rng.integers(0, 9000, 40 + i % 3))])) for i in range(30)]
    rows += [(100 + i, t + f" y{i}") for i, t in rows[:12]]
    rows += [(200 + i, t + f" z{i}") for i, t in rows[30:36]]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(frame, words=2, percent=90, rows=1, miss=1e-30, block=block, most=most).collect()}
    assert found == graph(rows, 2, 90)


def test_bands_leave_few_pairs_unmet():
    assert [bands_for(p, 6, 1e-5) for p in (80, 85, 100)] == [38, 25, 1]
    assert (1 - 0.8**6) ** 38 <= 1e-5 < (1 - 0.8**6) ** 37
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64)) for _ in range(2)]
    both = np.unique(np.concatenate([sets[0][:350], sets[1][:50]]))
    low = signatures([sets[0], both], 2000)
    assert abs((low[0] == low[1]).mean() - 350 / 450) < 0.05


def test_very_long_texts_are_compared_in_small_groups(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(i, long + f" end{i}") for i in range(12)] + [(20 + i, "short text of a few words " + f"x{i}") for i in range(3)]
    found = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, SCHEMA), most=100_000).collect()}
    assert found == {i: 0 if i < 20 else i for i, _ in rows}


def test_null_and_repeated_ids(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], SCHEMA)
    found = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup(frame).collect()), key=str)
    assert found == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_links_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
    wanted = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(a := np.intersect1d(sets[i], sets[j])) >= 50 * (len(sets[i]) + len(sets[j]) - len(a))}
    assert set(linked(sets, 50)) == wanted


def test_shingles_of_short_texts():
    hashes = defaultdict(lambda: 1)
    assert [len(shingles(t, 3, hashes)) for t in (b"", b"a", b"a b", b"a b c")] == [0, 1, 1, 1]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(1, 20)]
    frame = spark.createDataFrame([*pairs, (None, 1), (5, 5)], "a long, b long")
    found = {r.v: r.component for r in components(frame).collect()}
    least = {v: v for p in pairs for v in p if p[0] != p[1]}
    for _ in range(40):
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    from galvanite.llm import components as module

    names = []
    monkeypatch.setattr(module, "written", lambda df, name, write=module.written: (names.append(name), write(df, name))[1])
    path = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(path).agg(F.max("component"), F.count("*")).first()[:] == (0, 2001)
    assert names.count("names") <= 20


def test_different_texts_under_one_id(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (5, c), (5, c + " x"), (7, b + " y"), (7, "alone in the world"), (None, a)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = near_dedup(frame.withColumn("own", frame.text), carry=["own"]).collect()
    wanted = {(1, a): 1, (1, b): 1, (2, a + " x"): 1, (3, b + " x"): 1, (5, c): 5, (5, c + " x"): 5, (7, b + " y"): 1, (7, "alone in the world"): 7, (None, a): None}
    assert {(r.doc_id, r.own): r.component_id for r in found} == wanted
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near(spark, frame, "").collect()}
    assert kept == {k for k, v in wanted.items() if k[0] == v}
