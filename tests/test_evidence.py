import io
import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from galvanite.functions import naming
from galvanite.operators import jobs, mapping, payloads
from galvanite.sources import packages
from galvanite.sources.archives import listed, members, members_at, unsafe
from galvanite.sources.delimited import profile_problems
from galvanite.streaming import campaigns, leases


def zipped(**names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, data in names.items():
            box.writestr(name, data)
    return out.getvalue()


def test_packages_that_cannot_be_read_are_rows(spark):
    good = packages.package({"a.txt": b"one", "b.txt": b"two" * 50})
    bad_crc = bytearray(good)
    at = bad_crc.index(b"a.txt") + 5
    bad_crc[at] ^= 0xFF
    encrypted = bytearray(zipped(x=b"data", manifest=b"{}"))
    for mark, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        place = encrypted.index(mark) + offset
        encrypted[place : place + 2] = struct.pack("<H", struct.unpack("<H", encrypted[place : place + 2])[0] | 1)
    bomb = zipped(zeros=b"\0" * 50_000_000)
    rows = [("good", good), ("crc", bytes(bad_crc)), ("locked", bytes(encrypted)), ("bomb", bomb), ("text", b"no zip"), ("none", None)]
    frame = spark.createDataFrame(rows, "path string, content binary")
    found = {(r.path, r.member, r.problem) for r in packages.verify(frame).collect()}
    assert ("crc", "a.txt", "unreadable_member") in found
    assert ("locked", "x", "unreadable_member") in found
    assert {(p, q) for p, _, q in found if p in ("bomb", "text", "none")} == {("bomb", "ratio_too_high"), ("text", "unreadable"), ("none", "unreadable")}
    assert not [x for x in found if x[0] == "good"]
    assert members(frame.where("path = 'bomb'")).first().content is None
    assert [r.problem for r in unsafe(members(frame.where("path = 'good'"), content=False), most_members=1).collect()] == ["too_many_members"]


def test_archives_are_read_member_by_member_where_they_lie(spark, tmp_path):
    rng = random.Random(3)
    large = zipped(**{f"m{i:03d}": rng.randbytes(2000) for i in range(200)}, empty=b"")
    bad = bytearray(zipped(a=b"one" * 9, b=b"two"))
    bad[bad.index(b"a", 20) + 3] ^= 0xFF
    files = {"large": large, "bad": bytes(bad), "bomb": zipped(zeros=b"\0" * 50_000_000), "text": b"no zip", "folder": zipped(**{"d/": b"", "d/x": b"1"}), "climbs": zipped(**{"../x": b"1"})}
    for name, data in files.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    paths = [str(tmp_path / f"{n}.zip") for n in files] + [str(tmp_path / "absent.zip"), f"file://{tmp_path}/large.zip"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    held = spark.createDataFrame([(p, files.get(p.rsplit("/", 1)[1][:-4])) for p in paths], "path string, content binary")
    rows = lambda f: sorted((tuple(r) for r in f.collect()), key=str)
    assert rows(members_at(frame, range_bytes=10_000)) == rows(members(held))
    ranges = listed(frame.where(F.col("path").endswith("/large.zip") & ~F.col("path").startswith("file:")), range_bytes=10_000).groupBy("range").agg(F.sum("packed").alias("b")).collect()
    assert len(ranges) > 30 and max(r.b for r in ranges) < 13_000  # no task needs more of one archive


def test_bundles_are_the_same_bytes_each_time(spark):
    events = spark.createDataFrame([(2, "b"), (1, "a")], "campaign_position long, event_id string")
    seen, made = spark.createDataFrame([("o", "a")], "observation_id string, attempt_id string"), spark.createDataFrame([("m",)], "metric_id string")
    one = packages.bundle(events, seen, made)
    assert one == packages.bundle(events.repartition(3), seen, made)
    assert packages.verify(spark.createDataFrame([("p", one)], "path string, content binary")).count() == 0
    with zipfile.ZipFile(io.BytesIO(one)) as box:
        assert [json.loads(x)["event_id"] for x in box.read("events.jsonl").splitlines()] == ["a", "b"]


CV = {"technique": "cyclic_voltammetry", "encoding": "utf-8", "delimiter": ",", "decimal_convention": "point", "header_row": 1, "missing_value_tokens": [""], "columns": [{"source_column": "E", "role": "potential"}, {"source_column": "I", "role": "current"}]}
EL = CV | {"technique": "galvanostatic_electrolysis", "columns": [{"source_column": "t", "role": "time", "source_unit": "s", "target_unit": "s"}, *CV["columns"]], "metadata": {"current_basis": {"state": "known", "value": "total_current"}, "electrode_area": {"state": "not_applicable"}}}


@pytest.mark.parametrize(
    ("profile", "wanted"),
    [
        (CV, []),
        (EL, []),
        (CV | {"columns": []}, ["no_columns", "one_potential", "one_current"]),
        (CV | {"decimal_convention": "comma"}, ["comma_is_ambiguous"]),
        (CV | {"columns": [*CV["columns"], {"source_column": "E", "role": "potential"}]}, ["repeated_column", "one_potential"]),
        (EL | {"columns": EL["columns"][1:]}, ["one_time"]),
        (EL | {"metadata": {}}, ["current_context"]),
        (EL | {"auxiliary_results": [{"result_id": "r"}, {"result_id": "r"}]}, ["auxiliary_context", "repeated_result"]),
        (EL | {"columns": [{"source_column": "t", "role": "time", "source_unit": "min"}, *CV["columns"]]}, ["unit_of_other_role"]),
    ],
)
def test_profiles_must_be_complete(profile, wanted):
    assert profile_problems(json.dumps(profile)) == wanted


def test_small_rules(spark):
    frame = spark.createDataFrame([("a;b;c\n1;2;3\n4;5;6\n",), ("a|b\n1|2\n",), ("x",), (None,)], "t string")
    assert [r[0] for r in frame.select(naming.sniffed_delimiter()(F.col("t"))).collect()] == [";", "|", ",", ","]
    assert sorted(set(mapping.leaves({"a": [], "b": {"c": [1, {"d": None}]}, "e": {}}))) == ["/a", "/b/c/0", "/b/c/1/d", "/e"]
    documents = spark.createDataFrame([(1, "[]"), (2, "nope"), (3, None)], "k long, t string")
    assert sorted(map(tuple, mapping.exported_paths(documents, "k", "t").collect())) == [(1, ""), (2, "!"), (3, "!")]
    plan = jobs.fault_plan(["a", "b", "c"], 7, 3)
    assert sorted(plan) == ["a", "a", "a", "b", "b", "c", "c"]
    assert plan == jobs.fault_plan(["a", "b", "c"], 7, 3)
    with pytest.raises(ValueError, match="every"):
        jobs.fault_plan(["a", "b"], 1, 0)


def test_payload_rules(spark):
    relation = {"relation_id": "r", "subject_id": "x", "predicate": "invalidates", "object_id": "x", "reason": "w", "recorded_at": "t"}
    cases = [
        ("observation.invalidated", "campaign", relation, "relates_to_itself"),
        ("observation.superseded", "campaign", relation | {"object_id": "y"}, "predicate:invalidates"),
        ("work_item.quarantined", "work_item", {"state": "quarantined"}, "reason_required"),
        ("work_item.quarantined", "work_item", {"state": "quarantined", "reason": "r"}, None),
        ("campaign.failed", "campaign", {"state": "failed", "reason": ""}, "reason_required"),
        ("campaign.paused", "campaign", {"state": "active"}, "state:active"),
        ("campaign.paused", "campaign", {"state": None}, "missing:state"),
        ("campaign.paused", "campaign", {"state": "paused", "odd": 1}, "unknown:odd"),
    ]
    rows = [("c", i, f"e{i}", t, 1, a, "c", "z", json.dumps(p)) for i, (t, a, p, _) in enumerate(cases)] + [("c", 99, "e99", "campaign.paused", 1, "campaign", "c", "z", "no json")]
    frame = spark.createDataFrame(rows, "campaign_id string, campaign_position int, event_id string, event_type string, schema_version int, aggregate_type string, aggregate_id string, causation_id string, payload string")
    found = {r.campaign_position: r.detail for r in payloads.problems(frame).collect()}
    assert found == {i: d for i, (*_, d) in enumerate(cases) if d} | {99: "not_an_object"}


def run_stream(spark, tmp_path, frame, name, build):
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    campaigns.with_rocksdb(spark)
    query = build(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_leases_run_out_on_a_stream(spark, tmp_path):
    rows = [("a", 1, "00:10", False, "00:00"), ("a", 1, "00:20", False, "00:05"), ("b", 1, "00:10", False, "00:00"), ("b", 1, "00:10", True, "00:08"), ("c", 2, "09:00", False, "00:00"), ("d", 1, "01:00", False, "02:00"), ("z", 1, "23:00", True, "02:05")]
    time = lambda c: F.to_timestamp(F.concat(F.lit("2024-01-01 "), c))
    frame = spark.createDataFrame(rows, "job_id string, lease_generation long, e string, ended boolean, s string").select("job_id", "lease_generation", time("e").alias("lease_expires_at"), "ended", time("s").alias("seen_at"))
    found = run_stream(spark, tmp_path, frame, "ran_out", lambda s: leases.expirations(s, "seen_at", "1 minute"))
    assert sorted((r.job_id, r.lease_generation, str(r.expired_at)[11:16]) for r in found) == [("a", 1, "00:20"), ("d", 1, "01:00")]


def test_late_results_are_kept_and_never_accepted(spark, tmp_path):
    rows = [("a", "1", 1, "lease"), ("a", "2", 2, "lease"), ("a", "3", 1, "result"), ("a", "4", 2, "result"), ("a", "5", 2, "result"), ("b", "6", 0, "result"), ("z", "99", 1, "lease")]
    frame = spark.createDataFrame(rows, "job_id string, event_id string, lease_generation long, kind string").withColumn("at", F.timestamp_seconds(F.col("event_id").cast("long") * 60))
    found = run_stream(spark, tmp_path, frame, "judged", lambda s: leases.judged_results(s, "at", "1 minute"))
    assert sorted((r.event_id, r.status) for r in found) == [("3", "received"), ("4", "accepted"), ("5", "duplicate_suppressed"), ("6", "accepted")]
