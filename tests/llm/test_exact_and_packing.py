import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galvanite.llm.exact_dedup import exact_dedup
from galvanite.llm.packing import best_fit, encoder, pack_documents, padding, token_ids

ROWS = [(1, "same"), (2, "same"), (3, ""), (4, None), (5, "x" * 9000), (6, "x" * 9000), (7, "x" * 8999 + "y"), (None, "same"), (8, "é" * 3000), (2, "same"), (9, "x" * 4096), (10, "x" * 8192)]
SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("block", [7, 2048])
def test_exact_groups(spark, block):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], SCHEMA + ", block string")
    found = exact_dedup(frame, block=block).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(found) == len(ROWS)
    for r in found:
        own = groups[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == max((x for x in own if x is not None), default=None)
    for sha, own in groups.items():
        assert [r.doc_id for r in found if r.text_sha256 == sha and r.kept] == [max(x for x in own if x is not None)]


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(frame).count() == 0
    import public_tokenizers

    assert pack_documents(frame, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_best_fit_is_the_plain_search(lengths):
    sequence, offset, made = best_fit(np.array(lengths, dtype=np.int64), 64)
    rooms, wanted = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            room = min(fits)
            rooms.remove(room)
        else:
            room = 64
        rooms.append(room - lengths[i])
        wanted[i] = 64 - room
    assert [offset[i] for i in range(len(lengths))] == [wanted[i] for i in range(len(lengths))]
    assert made == len(rooms)


def test_pieces_cover_every_token_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 3000), (5, "<|endoftext|> é　\t\n\n  x"), (1, "a b c"), (None, "it's 12\x0b"), (6, "\n" * 50)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in texts], SCHEMA + ", start int")
    found = pack_documents(frame, path, group=3).collect()
    own = Tokenizer.from_file(path)
    ids = {(i, t): [*own.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    for (i, t), tokens in ids.items():
        pieces = sorted((r for r in found if r.doc_id == i and r.doc_tokens == len(tokens)), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(tokens) * texts.count((i, t)) or (i, t) in ((2, None), (3, ""))
        for r in pieces:
            raw = np.array(tokens[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_fast_ids_are_the_tokenizers_own(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["a<|endoftext|>b", " <|endoftext|> <|endoftext|>", "<|end", " " * 100_000 + "x", "\n" * 100_000, "é" * 5000]
    assert [encoder(path).encode(t, allowed_special="all") for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_more_than_a_million_spaces(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = {1: "a" + " " * 1_200_000 + "b<|endoftext|>", 2: "\n" * 1_100_000, 3: "plain"}
    found = pack_documents(spark.createDataFrame([*texts.items()], SCHEMA), path).collect()
    own = Tokenizer.from_file(path)
    for i, text in texts.items():
        ids = [*own.encode(text, add_special_tokens=False).ids, 0]
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found if r.doc_id == i)
        assert pieces == [(k, len(ids[k : k + 1024]), zlib.crc32(np.array(ids[k : k + 1024], dtype="<u4").tobytes()), len(ids)) for k in range(0, len(ids), 1024)]


def test_padding_is_little(spark, sf_dir):
    import public_tokenizers

    assert padding(np.array([1, 2, 3, 512, 700, 1023, 1024]), 1024).tolist() == [0, 0, 1021, 0, 324, 1, 0]
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).groupBy("sequence_id").sum("length").collect()
    used = np.array([r[1] for r in rows])
    assert padding(used, 1024).sum() <= 0.005 * used.sum()


def test_other_files_go_to_their_own_tokenizer(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    file = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert encoder(public_tokenizers.path("byte_bpe_50k.json")) is not None
    texts = ["Some words, some more  words", "it's <|endoftext|>", ""]
    changes = {"prefix": {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}, "lower": {"normalizer": {"type": "Lowercase"}}, "order": {"model": file["model"] | {"merges": file["model"]["merges"][1:] + file["model"]["merges"][:1]}}}
    for name, change in changes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(file | change), encoding="utf-8")
        assert encoder(str(path)) is None
        own = Tokenizer.from_file(str(path))
        assert [token_ids(str(path), t) for t in texts] == [own.encode(t, add_special_tokens=False).ids for t in texts]
