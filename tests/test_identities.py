"""Nested identities without Python, and objects under their digests."""

import hashlib
import json
import random
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from galvanite.functions import canonical
from galvanite.sources import objects


def nested(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.randrange(-(10**12), 10**12)
    if kind < 5:
        return "".join(rng.choice('abzAZ09 _-"\\/\n\téüß{}[]:,.eE') for _ in range(rng.randrange(7)))
    if kind == 5:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice("abAB é.0") for _ in range(rng.randrange(1, 4))): nested(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_variants_give_the_identities_of_nested_records(spark):
    rng = random.Random(4)
    texts = [json.dumps(nested(rng), ensure_ascii=False, indent=rng.choice([None, 1])) for _ in range(400)]
    texts += ['{"a": 1.50}', '{"a": 1e3}', '{"e": "1.5", "E": "2e3"}', '{"x": "é"}', '{"x": "\\u0041"}', '{"a": 1, "a": 2}', '{"x": " "}', "123456789012345678901234567890123456789012", "-0", '"\x7f"', '{"Å": 1}', '{"😀": 1, "ﬀ": 2}']
    bad = ["nope", "", "NaN", '{"a": Infinity}', "[1,", None]
    frame = spark.createDataFrame(list(enumerate(texts + bad)), "k long, t string")
    found = {r.k: r.content_id for r in canonical.with_content_id(frame, "t", "thing").collect()}
    for k, text in enumerate(texts):
        assert found[k] == canonical.content_id("thing", json.loads(text, parse_float=Decimal)), text
    assert len(found) == len(texts + bad) and all(found[len(texts) + i] is None for i in range(len(bad)))


def test_most_identities_need_no_python(spark, capsys):
    frame = spark.range(3).select(F.to_json(F.struct(F.struct(F.col("id").alias("b"), F.lit("x").alias("a")).alias("o"))).alias("t"))
    canonical.with_content_id(frame, "t", "k").explain()
    native = capsys.readouterr().out.split("Union")[1].split("ArrowEvalPython")[0]
    assert "sha2" in native and "to_json" in native  # the first branch has no Python


def test_objects_are_hashed_before_use(spark, tmp_path):
    contents = [b"one", b"two" * 1000, b"", b"one", None]
    frame = spark.createDataFrame([(c,) for c in contents], "content binary").repartition(3)
    stored = objects.put_verified(frame, str(tmp_path)).collect()
    assert sorted((r.sha256 or "", r.problem or "") for r in stored) == sorted((hashlib.sha256(c).hexdigest(), "") if c is not None else ("", "no_content") for c in contents)
    assert len([p for p in Path(tmp_path).rglob("*") if p.is_file()]) == 3
    again = objects.put_verified(frame, str(tmp_path)).where("problem is null")
    assert again.count() == 4 and len([p for p in Path(tmp_path).rglob("*") if p.is_file()]) == 3
    uri = lambda c: f"{tmp_path}/{hashlib.sha256(c).hexdigest()[:2]}/{hashlib.sha256(c).hexdigest()}"
    asked = [(uri(c), len(c), hashlib.sha256(c).hexdigest()) for c in (b"one", b"two" * 1000, b"", b"gone")] + [(uri(b"one"), 4, hashlib.sha256(b"one").hexdigest()), ("/etc/hosts", 3, hashlib.sha256(b"one").hexdigest()), (None, None, None)]
    Path(uri(b"two" * 1000)).write_bytes(b"owt" * 1000)
    found = objects.fetch_verified(spark.createDataFrame(asked, "object_uri string, byte_size long, sha256 string"), str(tmp_path)).collect()
    assert sorted((r.problem or "", bytes(r.content) if r.content is not None else None) for r in found if r.content is not None) == [("", b""), ("", b"one")]
    assert sorted(r.problem for r in found if r.problem) == ["checksum_mismatch", "object_missing", "object_missing", "outside_store", "size_mismatch"]
