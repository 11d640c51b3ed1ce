import numpy as np
from pyspark.sql import functions as F

from galvanite.llm.embedding_dedup import code_words, embedding_dedup, list_decode
from galvanite.llm.queries import RULES
from galvanite.llm.url_filter import judge_urls, reputation, suffix_of


def test_rules_hosts_and_paths(spark):
    urls = ["http://a.NET/x", "http://b.example.net/en/1", "http://example.com/de/?q", "https://x.org/fr/", "no url", None, "http://h", "http://net", "a://b://c/d", "http://badexample.net/en/"]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, bad long, n long")
    found = [tuple(r)[1:] for r in judge_urls(frame, none, RULES).orderBy("page_id").collect()]
    assert found == [
        ("a.net", "/x", "net/", "block"),
        ("b.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.com", "/de/", "example.com/de/", "block"),
        ("x.org", "/fr/", "org/fr/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h", "", None, "allow"),
        ("net", "", None, "allow"),
        ("b:", "//c/d", None, "allow"),
        ("badexample.net", "/en/", "net/", "block"),
    ]


def test_reputation_blocks_only_what_is_sure(spark):
    hosts = [("bad.evil.com", 90, 100), ("new.evil.com", 1, 1), ("good.fine.com", 5, 100), ("one.fine.org", 1, 1)] + [(f"h{i}.site{i}.com", 5, 100) for i in range(30)]
    outcomes = spark.createDataFrame(hosts, "host string, bad long, n long")
    rates = {r.host: r for r in reputation(outcomes).collect()}
    assert rates["new.evil.com"].rate > rates["one.fine.org"].rate
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, (h, _, _) in enumerate(hosts)], "page_id long, url string")
    blocked = {r.host for r in judge_urls(pages, outcomes, ()).collect() if r.verdict == "block"}
    assert blocked == {"bad.evil.com", "new.evil.com"}  # the new host has its domain's reputation; one bad page elsewhere is not enough
    assert judge_urls(pages.limit(0), outcomes, RULES).count() == 0


def test_registered_domains(spark):
    hosts = [("a.b.co.uk", 9, 10), ("b.co.uk", 1, 10), ("c.co.uk:8080", 5, 10), ("co.uk", 1, 2), ("x.org:80", 1, 1), ("x.org", 0, 9)]
    frame = spark.createDataFrame(hosts, "host string, bad long, n long")
    names = frame.select("host", suffix_of(F.regexp_replace("host", ":[0-9]*$", ""), ["co.uk"]).alias("s")).collect()
    assert {r.host: r.s for r in names} == {"a.b.co.uk": "co.uk", "b.co.uk": "co.uk", "c.co.uk:8080": "co.uk", "co.uk": "co.uk", "x.org:80": "org", "x.org": "org"}
    far, near = ({r.host: r.rate for r in reputation(frame, suffixes=s).collect()} for s in ((), ("co.uk",)))
    assert far.keys() == near.keys() == {h for h, _, _ in hosts}
    assert near["a.b.co.uk"] != far["a.b.co.uk"]  # b.co.uk and c.co.uk no longer share a domain


def test_lists_are_all_exceeding_directions():
    rng = np.random.default_rng(0)
    unit = rng.standard_normal((30, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = code_words(8, 2, 16, 1)
    at, name = list_decode(unit, codes, 0.9)
    every = np.array([np.concatenate([a, b]) for a in codes[0] for b in codes[1]])
    assert {*zip(at.tolist(), name.tolist(), strict=True)} == {*map(tuple, np.argwhere(unit @ every.T >= 0.9).tolist())}


def brute(rows):
    ids = [r[0] for r in rows]
    fit = [r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = {i: 0 for i in ids}
    root = {i: i for i in ids}
    for a, (i, v, x) in enumerate(rows):
        for b, (j, w, y) in enumerate(rows):
            if a < b and fit[a] and fit[b] and x == y and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i] += 1
                links[j] += 1
                least = min(root[i], root[j])
                old = {root[i], root[j]}
                root = {k: least if r in old else r for k, r in root.items()}
    return {i: (links[i], root[i]) for i in ids}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [(100 * c + k, [float(np.float32(x)) for x in centre + rng.standard_normal(16) * 0.06], c % 3) for k in range(12)]
    rows += [(5000 + k, rows[0][1], 0) for k in range(5)] + [(6000, [2 * x for x in rows[0][1]], 0), (6001, rows[0][1], None), (6002, None, 0), (6003, [0.0] * 16, 0), (6004, [float("nan")] * 16, 0), (6005, [None] * 16, 0), (6006, [1.0, 2.0], 0), (6007, [1.0, 2.0], 0), (6008, [], 0)]
    frame = spark.createDataFrame([(i, v, x, "c") for i, v, x in rows], "vec_id long, embedding array<double>, label int, place string")
    wanted = brute(rows)
    for block in (512, 8):
        found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(frame, block=block, together=64).collect()}
        assert found.keys() == wanted.keys()
        have, want = sum(x for x, _ in found.values()), sum(x for x, _ in wanted.values())
        assert 0.9 * want <= have <= want
        assert all(found[i][0] <= wanted[i][0] for i in wanted)
        assert sum(found[i] == wanted[i] for i in wanted) >= 0.95 * len(wanted)
    assert embedding_dedup(frame.limit(0)).count() == 0
    odd = embedding_dedup(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in odd) == [(0, 0, True), (1, 0, True)]


def test_recall_on_the_given_vectors(spark, sf_dir):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    unit = np.array([v for _, v, _ in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([-1 - i if x is None else x for i, (_, _, x) in enumerate(rows)])
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    found = embedding_dedup(frame).agg(F.sum("n_links")).first()[0]
    assert 0.9 * (close.sum() - len(rows)) <= found <= close.sum() - len(rows)


def test_defaults_recall_low_sparse_and_concentrated_vectors(spark):
    rng = np.random.default_rng(9)
    kinds, rows, wanted = [(d, "plain") for d in (1, 2, 4, 8, 9, 16, 24, 32, 64)] + [(64, "half"), (128, "half"), (384, "half"), (384, "four"), (16, "huge"), (8, "tiny")], [], {}
    for label, (d, kind) in enumerate(kinds):
        shape = np.ones((60, d))
        if kind == "half":
            shape[:, d // 2 :] = 0.02
        if kind == "four":
            shape = np.array([np.isin(np.arange(d), rng.choice(d, 4, replace=False)) for _ in range(60)], float)
        x, y = rng.standard_normal((2, 60, d)) * shape
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = x + 0.174 * y / np.linalg.norm(y, axis=1, keepdims=True) if d > 1 else 2 * x  # cosine 0.985
        both = np.concatenate([x, y])
        unit = both / np.linalg.norm(both, axis=1, keepdims=True)
        wanted[label] = int((unit @ unit.T >= 0.98).sum()) - 120
        assert wanted[label] >= 120
        rows += [(1000 * label + i, (v * {"huge": 1e200, "tiny": 1e-200}.get(kind, 1)).tolist(), label) for i, v in enumerate(both)]
    found = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = {r[0]: r[1] for r in found.groupBy(F.floor(F.col("vec_id") / 1000)).agg(F.sum("n_links")).collect()}
    for label, (d, kind) in enumerate(kinds):
        assert (1.0 if d <= 8 else 0.95) * wanted[label] <= found[label] <= wanted[label], (d, kind)
