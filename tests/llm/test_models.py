import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvanite.llm import context_tree, language_id, quality, sentence_pieces
from galvanite.llm.common import remainder
from galvanite.llm.queries import op1_quality, op4_language_id

SCHEMA = "doc_id long, text string"


def test_context_tree_against_brute_force(spark):
    depth, rng = 4, np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Sat", "on", "a", "mat,", "é"], rng.integers(0, 9)))) for i in range(40)] + [(50, None), (51, "zebra\tquick"), (52, "the " * 300)]
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], SCHEMA + ", n int")
    found = {r.doc_id: r for r in context_tree.score_documents(frame, remainder(F.col("doc_id"), 7) != 2, depth=depth, words=3, common=5).collect()}
    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for t in learnt for w in tokens(t))
    spell = lambda t: b" " * depth + b" ".join(tokens(t)[:-1]) + b"\n"
    n = Counter()
    for t in learnt:
        raw = spell(t)
        for j in range(depth, len(raw)):
            for d in range(depth + 1):
                for k in range(8):
                    n[raw[j - d : j], d, (1 << k) + (raw[j] >> (8 - k)), raw[j] >> (7 - k) & 1] += 1
    nodes = {k[:3] for k in n}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    stop, mixed = {}, {}
    for c, d, node in sorted(nodes, key=lambda x: -x[1]):
        own = kt(n[c, d, node, 0], n[c, d, node, 1])
        if d == depth:
            stop[c, d, node], mixed[c, d, node] = 1.0, own
        else:
            below = sum(mixed[x] for x in nodes if x[1] == d + 1 and x[0][1:] == c and x[2] == node)
            mixed[c, d, node] = np.logaddexp(own, below) - math.log(2)
            stop[c, d, node] = 1 / (1 + math.exp(min(700, below - own)))

    def score(t):
        raw, total = spell(t), 0.0
        for j in range(depth, len(raw)):
            for k in range(8):
                node, bit, p = (1 << k) + (raw[j] >> (8 - k)), raw[j] >> (7 - k) & 1, 0.0
                for d in range(depth, -1, -1):
                    key = (raw[j - d : j], d, node)
                    own = (n[(*key, bit)] + 0.5) / (n[(*key, 0)] + n[(*key, 1)] + 1)
                    share = stop.get(key, 1.0 if d == depth else 0.5)
                    p = own if d == depth else share * own + (1 - share) * p
                total += math.log10(p)
        return total

    for i, t in rows:
        r = found[i]
        own = tokens(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), counts.total())
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (counts.total() + len(counts) + 1)) for w in own))
        assert r.score == pytest.approx(score(t))


def test_log_gamma():
    x = np.array([0.5, 1, 2.5, 40, 1e6])
    assert context_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


def test_empty_corpus(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert context_tree.score_documents(frame, F.lit(True)).count() == 0
    assert language_id.predict(frame, language_id.train(frame.withColumn("lang", F.lit("en")))).count() == 0
    assert quality.quality(frame, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).count() == 0


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a b"), (None, None)], SCHEMA)
    assert all(math.isfinite(r.score) for r in context_tree.score_documents(frame, F.lit(False)).collect())
    assert [r.score for r in quality.quality(frame, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).collect()] == [0.5, 0.5]


def test_grams_of_a_long_text_come_in_slices():
    text = "Über die Brücke gehen 12 Leute. ".encode() * 40
    owner = np.zeros(1, np.int64)
    whole, sliced = language_id.grams([text], owner), language_id.grams([text], owner, size=97)
    assert all((a == b).all() for a, b in zip(whole, sliced, strict=True))
    plain = Counter(bytes([b]) for b in text.lower() if 97 <= b <= 122 or b > 127)
    assert {c: n for _, c, n in zip(*whole, strict=True) if c < 155} == {int(language_id._SYMBOL[k[0]]): n for k, n in plain.items()}


def test_languages(spark, sf_dir):
    rows = op4_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    frame = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "12 34 !", None), (4, None, "en"), (5, "", None), (6, "le chien", None)], SCHEMA + ", lang string")
    found = {r.doc_id: r for r in language_id.predict(frame, language_id.train(frame)).collect()}
    assert [found[i].lang_pred for i in range(1, 7)] == ["en", "fr", "und", "und", "und", "fr"]
    assert all(0 <= r.score <= 1 for r in found.values())


def test_quality_is_learnt(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    rows = op1_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows)


def test_statistics_are_finite():
    for text in (b"", b" ", b"\xff\x00", b"a" * 100_000, b"\n" * 50, b"$ " * 9):
        assert np.isfinite(quality.statistics(text)).all()
        assert len(quality.statistics(text)) == len(quality.NAMES)


def test_cholesky_scores_are_log_density_differences():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = {0: rng.normal(1, 2, (300, d)), 1: rng.normal(0, 1, (500, d))}
    moments = {k: np.c_[v, np.ones(len(v))].T @ np.c_[v, np.ones(len(v))] for k, v in x.items()}
    model = quality.Discriminant(moments, 0.0, 0.0)
    at = rng.normal(0, 1, (20, d))
    logs = {}
    for k, v in x.items():
        c, gap = np.cov(v.T, bias=True), at - v.mean(axis=0)
        logs[k] = -0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap) + np.linalg.slogdet(c)[1])
    wanted = 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(501 / 301))))
    assert model.score(at) == pytest.approx(wanted, rel=1e-3, abs=1e-6)


def test_pieces_are_the_models_own(spark, sf_dir):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = SentencePieceProcessor(model_file=path)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["  a  b\nc\t ", " ", "", "     x      y", "a▁b", "ﬁ ｆ①é é", "日本語 中文 🙂🙂", "\x00 a", "a\n\n  b\n", "x" * 5000]
    frame = spark.createDataFrame([*enumerate(texts), (None, None)], SCHEMA)
    for r in sentence_pieces.encode_documents(frame, path).collect():
        text = "" if r.doc_id is None else texts[r.doc_id]
        assert r.ids == own.encode(text)
        assert r.round_trip == ("▁" not in text)
        if r.doc_id is None or r.doc_id > 195:
            assert r.score == pytest.approx(sum(own.get_score(i) for i in own.encode(text) if not own.is_byte(i)))
    assert sentence_pieces.encode_documents(frame.limit(0), path).count() == 0
    twice = spark.createDataFrame([(1, "a word", 5, "x"), (1, "a word", 6, "y")], SCHEMA + ", n_tokens long, ids string")
    assert [(r.doc_id, r.ids) for r in sentence_pieces.encode_documents(twice, path).collect()] == [(1, own.encode("a word"))] * 2


def test_runs_of_marks_take_the_same_path():
    import public_tokenizers

    model = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    units = sorted({"▁" * n + w for n in range(1, 40) for w in ("", "a", "word", "Über", "。", "zzzq")})
    for unit, pieces, score in model.walk(units):
        assert pieces == model.merged(unit)
        assert score == pytest.approx(sum(model.score.get(p, 0.0) for p in pieces))


def test_places_take_two_bytes_while_they_suffice():
    from galvanite.llm import language_id

    for top, size in ((100, 1), (400, 2), (32_767, 2), (40_000, 4)):
        held = language_id.unseen(2, top)
        assert held.itemsize == size and held.shape == (2, language_id.GRAMS) and held[1, -1] == top


def test_a_task_needs_little_more_than_its_batch():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + k) for k in rng.integers(0, 26, 6)) for _ in range(5000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(3000)]  # some 6 MB
    batch = pa.RecordBatch.from_pydict({"_doc_id": list(range(3000)), "_text": texts, "text": texts, "lang": ["en", "de"] * 1500, "letters": [True] * 3000})
    profile = lambda k: (np.arange(k, k + 400), np.arange(400))
    tracemalloc.start()
    try:
        own = pa.RecordBatch.from_arrays([batch["lang"], batch["text"]], names=["lang", "text"])
        assert sum(x.num_rows for x in language_id._counted(iter([own]))) > 0
        counting = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        sizes = [x.num_rows for x in language_id._predicted(["x", "y"], [profile(160), profile(500)], 400, ["_doc_id", "_text"], "_text")(iter([batch]))]
        predicting = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == 3000 and max(sizes) < 1000  # rows go back a part at a time
    assert counting < 60e6 and predicting < 70e6, (counting, predicting)


def test_a_carried_text_goes_to_python_once(spark, capsys):
    frame = spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr"), (3, None, None)], SCHEMA + ", lang string")
    found = language_id.predict(frame, language_id.train(frame), carry=frame.columns)
    assert sorted((r.doc_id, r.text, r.lang_pred) for r in found.where("text is not null").collect()) == [(1, "the cat", "en"), (2, "le chat", "fr")]
    found.explain("formatted")
    assert "letters" in (plan := capsys.readouterr().out)
    sent = next(x for x in plan.split("MapInArrow\nInput")[1].splitlines() if x)
    assert sent.count("text") == 1, sent
