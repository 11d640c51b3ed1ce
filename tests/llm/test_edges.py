"""Brute-force versions of the learnt operators, and odd inputs of all."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from galvanite.llm import context_tree, language_id, quality
from galvanite.llm.exact_dedup import exact_dedup
from galvanite.llm.substring_dedup import substring_dedup
from galvanite.llm.url_filter import judge_urls

SCHEMA = "doc_id long, text string"
LONG = "the cat sat on the mat and the dog ran to a log; " * 20_000  # a million characters


def test_shrunk_discriminant_against_plain_formulas(spark):
    rng = np.random.default_rng(3)
    d, pooled_share, identity_share = len(quality.NAMES), 0.3, 0.1
    x = {0: rng.normal(1, 2, (70, d)), 1: rng.normal(0, 1, (90, d)) @ rng.normal(0, 1, (d, d))}
    rows = [(v.tolist(), y) for y, values in x.items() for v in values] + [([0.0] * d, 2), ([1.0] * d, None)]
    model = quality.train(spark.createDataFrame(rows, "x array<double>, y long"), to_pooled=pooled_share, to_identity=identity_share)
    centred = np.concatenate([v - v.mean(axis=0) for v in x.values()])
    pooled = centred.T @ centred / len(centred)
    unit = np.sqrt(np.diag(pooled) + 1e-6)
    at, logs = rng.normal(0, 1, (25, d)), {}
    for y, values in x.items():
        own = (1 - pooled_share) * np.cov(values.T, bias=True) + pooled_share * pooled
        own = own / unit[:, None] / unit[None, :]
        own = (1 - identity_share) * own + identity_share * (np.trace(own) / d + 1e-6) * np.eye(d)
        z = (at - values.mean(axis=0)) / unit
        logs[y] = -0.5 * (np.einsum("ij,ij->i", z, np.linalg.solve(own, z.T).T) + np.linalg.slogdet(own)[1])
    wanted = 1 / (1 + np.exp(-(logs[1] - logs[0] + math.log(91 / 71))))
    assert model.score(at) == pytest.approx(wanted, rel=1e-9, abs=1e-12)


def plain_grams(text):
    """n-grams as tuples, from the definition."""
    raw = [0, *(b + 1000 if b > 127 else b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0 for b in text.encode()), 0, 0]
    out = Counter()
    for i in range(len(raw) - 2):
        a, b, c = raw[i : i + 3]
        if a:
            out[(a,)] += 1
        if a or b:
            out[a, b] += 1
        if b and (a or c):
            out[a, b, c] += 1
    return out


def plain_profile(counts, top):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:top])}


@pytest.mark.parametrize("top", [25, 400])
def test_rank_order_distances_against_plain_lists(spark, sf_dir, top):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    rows = [tuple(r) for r in docs.collect()] + [(9001, "Ünï ÇÖDÉ ünï", "xx"), (9002, "ab", None), (9003, "a", None)]
    frame = spark.createDataFrame(rows, SCHEMA + ", lang string")
    profiles = {x: plain_profile(sum((plain_grams(t or "") for _, t, y in rows if y == x), Counter()), top) for x in {y for _, _, y in rows if y}}
    found = {r.doc_id: r for r in language_id.predict(frame, language_id.train(frame, top=top), top=top).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert found[i].lang_pred == "und"
            continue
        own = plain_profile(plain_grams(text), top)
        far = {x: sum(abs(p[g] - k) if g in p else top for g, k in own.items()) / (len(own) * top) for x, p in profiles.items()}
        best = min(sorted(far), key=lambda x: far[x])
        assert (found[i].lang_pred, found[i].score) == (best, pytest.approx(1 - far[best]))


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a good text, it is.", 9), (1, "a good text, it is.", 9), (2, "$$$ 111", 9), (None, "x", 9), (3, None, 9), (4, LONG, 9), (5, "", 9)], SCHEMA + ", score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1), (5, None), (None, 1), (3, 7)], "doc_id long, quality int")
    found = quality.quality(docs, labels, F.lit(True)).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "3", "4", "5", "None"]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    assert {r.score for r in found if r.doc_id in (3, 5)} == {next(r.score for r in found if r.doc_id == 5)}


def test_languages_of_odd_rows(spark):
    rows = [(None, "le chat et le chien", "fr"), (1, "the cat", "en"), (1, "the cat", "en"), (2, LONG, "en"), (3, "le chien", None)]
    frame = spark.createDataFrame([(*r, 1.0, "y") for r in rows], SCHEMA + ", lang string, score double, lang_pred string")
    found = language_id.predict(frame, language_id.train(frame)).collect()
    assert sorted(((r.doc_id or 0), r.lang_pred) for r in found) == [(0, "fr"), (1, "en"), (1, "en"), (2, "en"), (3, "fr")]


def test_scores_of_odd_rows(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat"), (2, LONG), (3, None), (4, "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_tokens int")
    found = context_tree.score_documents(frame, F.col("doc_id") != 4).collect()
    assert len(found) == len(rows)
    assert len({(r.n_tokens, r.n_known, r.base_score, r.score) for r in found if r.doc_id in (1, None)}) == 1
    assert len({(r.n_tokens, r.base_score, r.score) for r in found if r.doc_id in (3, 4)}) == 1
    assert {r.train_tokens for r in found} == {3 + 3 + len(LONG.split()) + 1 + 1}  # a null condition learns nothing


def test_passages_and_copies_in_long_texts(spark):
    frame = spark.createDataFrame([(1, LONG), (2, LONG), (3, "short")], SCHEMA)
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(frame).collect()}
    n = len(LONG.split())
    assert found == {1: (n, n - 13), 2: (n, n), 3: (1, 0)}  # thirteen words come again and again
    assert {r.doc_id: r.kept for r in exact_dedup(frame).collect()} == {1: False, 2: True, 3: True}


def test_repeated_urls_are_judged_alike(spark):
    pages = spark.createDataFrame([(1, "http://a.org/fr/x", "r"), (1, "http://a.org/fr/x", "r"), (None, None, "r")], "page_id long, url string, rule string")
    outcomes = spark.createDataFrame([("b.org", 1, 1)], "host string, bad long, n long")
    found = sorted((str(r.page_id), r.host, r.verdict) for r in judge_urls(pages, outcomes, (("block", "org/fr/"),)).collect())
    assert found == [("1", "a.org", "block"), ("1", "a.org", "block"), ("None", "", "allow")]


DOCUMENTS = SCHEMA + ", lang string, source string, n_chars long"


def test_pipeline_of_odd_rows(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(None, "a b c", None, None, None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, "en", None, 0), (3, "", None, "s", 0), (4, "12 3", "en", "s", 4), (5, words, "en", "s", 1), (6, words + " x", "en", "s", 1)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    for name, keep in (("all", frame), ("none", frame.limit(0))):
        keep.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} == ({1, 5} if name == "all" else set())
    more = frame.withColumn("kept", F.lit("x")).withColumn("digest", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        more.write.mode("overwrite").parquet(f"{tmp_path}/more")
        out = stage(spark, spark.read.parquet(f"{tmp_path}/more"), "")
        assert out.columns == more.columns, name
        assert out.count() > 0
