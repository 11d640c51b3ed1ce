import zlib

import numpy as np
from test_substring_and_near import cut, graph

import corpus_pipeline


def test_run_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    base, passage = some(120), some(30)
    rows = [(i, " ".join([*base[:60], f"x{i}", *base[61:]])) for i in range(6)]  # near copies
    rows += [(10 + i, " ".join([*some(40 + i), *passage, *some(50)])) for i in range(8)]  # one shared passage
    rows += [(30, rows[7][1]), (31, rows[7][1]), (32, rows[0][1])]  # exact copies
    rows += [(40, " ".join(passage)), (41, None), (42, ""), (43, "12 345 !"), (44, "one  two\tthree"), (45, " ".join(some(900)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, ("en", "de")[i % 2], "s", len(t or "")) for i, t in rows], schema)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    docs = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    last = {t: max(i for i, u in docs if u == t) for _, t in docs}
    docs = [(i, t) for i, t in docs if last[t] == i]
    group = graph(docs, 5, 80)
    docs = [(i, t) for i, t in docs if group[i][1] == i]
    assert len(docs) < len(last)
    left = cut(docs, 20)
    docs = [(i, b" ".join(left[i][2]).decode() if left[i][1] else t) for i, t in docs if not left[i][1] or left[i][1] < left[i][0]]
    assert 40 not in dict(docs)
    assert sum(left[i][1] > 0 for i, _ in docs) >= 6
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, t in docs:
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        wanted += [(i, k, len(ids[k : k + 1024]), zlib.crc32(np.array(ids[k : k + 1024], dtype="<u4").tobytes()), len(ids)) for k in range(0, len(ids), 1024)]

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(wanted)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
