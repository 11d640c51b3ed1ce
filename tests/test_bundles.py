import hashlib
import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from galvanite.operators import replay
from galvanite.sources import bundles
from test_replay import STEPS, log

STAMP = "2026-01-01T00:00:00+00:00"
EVENT = "campaign_id string, aggregate_type string, aggregate_id string, sequence long, campaign_position long, event_id string, event_type string, causation_id string, correlation_id string, payload string"


def tables(spark, names=("c1", "c2", "c3"), versions=(2, 2, 2)):
    campaigns = spark.createDataFrame([(c, f"n {c}", "e", "observed", "replay", v) for c, v in zip(names, versions, strict=True)], "campaign_id string, campaign_name string, environment_id string, data_origin string, execution_mode string, event_stream_contract_version int")
    events = spark.createDataFrame([r for k, c in enumerate(names) for r in log(*STEPS[: 12 - k], campaign=c)], EVENT)
    events = events.withColumns({"schema_version": F.lit(1), "occurred_at": F.lit("2026-01-01T00:00:00Z"), "recorded_at": F.lit("2026-01-01T00:00:00Z"), "idempotency_key": F.lit(None).cast("string")})
    observations = spark.createDataFrame([(c, f"o{k}", f"a{k}", "ünï\n\"q\"") for c in names[:2] for k in (2, 1)], "campaign_id string, observation_id string, attempt_id string, note string")
    metrics = spark.createDataFrame([(names[0], "m", None)], "campaign_id string, metric_id string, value string")
    objects = observations.select("campaign_id", "observation_id", "attempt_id", F.concat(F.lit("s3://b/"), "observation_id").alias("object_uri"), F.lit(7).alias("byte_size"), F.sha2("observation_id", 256).alias("sha256"))
    return campaigns, events, observations, metrics, objects


def write(spark, path, *given, stamp=STAMP):
    bundles.register(spark)
    bundles.bundle_lines(*given).write.format("campaign_bundles").option("generated_at", stamp).mode("append").save(str(path))


def contents(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(Path(root).rglob("*")) if p.is_file()}


def test_bundles_are_written_by_tasks_and_are_the_same_bytes_each_time(spark, tmp_path):
    given = tables(spark)
    write(spark, tmp_path / "a", *given)
    write(spark, tmp_path / "b", *(g.repartition(3) for g in given))
    one = contents(tmp_path / "a")
    assert one == contents(tmp_path / "b")
    assert sorted(one) == sorted(f"{c}/{m}" for c in ("c1", "c2", "c3") for m in (*bundles.MEMBERS, "manifest.json"))
    manifest = json.loads(one["c1/manifest.json"])
    for entry in manifest["files"]:
        data = one[f"c1/{entry['name']}"]
        assert (hashlib.sha256(data).hexdigest(), len(data)) == (entry["sha256"], entry["byte_size"])
    assert manifest["manifest_digest"] == bundles.digest({k: v for k, v in manifest.items() if k != "manifest_digest"})
    seen = json.loads(one["c1/observations.json"])
    assert [o["observation_id"] for o in seen] == ["o1", "o2"] and one["c1/observations.json"] == bundles.file_bytes(seen)
    assert one["c3/observations.json"] == b"[]\n" and len(manifest["objects"]) == 2
    assert [json.loads(x)["campaign_position"] for x in one["c2/events.jsonl"].splitlines()] == list(range(1, 12))


def test_a_failed_or_repeated_job_leaves_nothing_new(spark, tmp_path):
    given = tables(spark)
    broken = given[1].withColumn("payload", F.when((F.col("campaign_id") == "c3") & (F.col("campaign_position") == 9), "no json").otherwise(F.col("payload")))
    with pytest.raises(Exception, match="."):
        write(spark, tmp_path, given[0], broken, *given[2:])
    assert contents(tmp_path) == {}
    write(spark, tmp_path, *(g.where("campaign_id <> 'c3'") for g in given))
    before = contents(tmp_path)
    with pytest.raises(Exception, match="destination exists"):
        write(spark, tmp_path, *given)
    assert contents(tmp_path) == before  # c3 neither
    with pytest.raises(Exception, match="UTC"):
        write(spark, tmp_path, *given, stamp="2026-01-01")


def test_streams_come_back_in_order_behind_the_gate(spark, tmp_path):
    given = tables(spark, versions=(2, 1, 0))
    write(spark, tmp_path, *given)
    load = lambda **o: spark.read.format("campaign_events").options(**o).load(str(tmp_path))
    with pytest.raises(Exception, match="legacy_stream"):
        load().collect()
    export = load(purpose="export", partitions=2)
    assert export.rdd.getNumPartitions() == 2
    rows = export.collect()
    assert len(rows) == 12 + 11 + 10
    for c in ("c1", "c2", "c3"):
        assert [r.campaign_position for r in rows if r.campaign_id == c] == list(range(1, 1 + sum(r.campaign_id == c for r in rows)))
    only = load().where("campaign_id = 'c1'")
    assert only.count() == 12  # the legacy campaign isn't even opened
    assert load(purpose="stream").where("campaign_id in ('c1', 'c2') and campaign_position > 3").count() == 9 + 8
    plain = lambda f: sorted(map(str, f.collect()))
    for name, table in replay.sections(only.withColumn("occurred_at", F.to_timestamp("occurred_at"))).items():
        assert plain(table) == plain(replay.sections(given[1].where("campaign_id = 'c1'").withColumn("occurred_at", F.to_timestamp("occurred_at")))[name]), name


def test_gaps_are_refused(spark, tmp_path):
    campaigns, events, *rest = tables(spark)
    write(spark, tmp_path, campaigns, events.where("not (campaign_id = 'c2' and campaign_position = 4)"), *rest)
    with pytest.raises(Exception, match="campaign_position_gap"):
        spark.read.format("campaign_events").load(str(tmp_path)).collect()
    assert spark.read.format("campaign_events").option("purpose", "export").load(str(tmp_path)).count() == 12 + 10 + 10


def test_a_stream_reads_what_was_appended(spark, tmp_path):
    write(spark, tmp_path / "all", *tables(spark))
    grown = tmp_path / "grown"
    shutil.copytree(tmp_path / "all" / "c1", grown / "c1")
    whole = (grown / "c1" / "events.jsonl").read_bytes().splitlines(keepends=True)
    (grown / "c1" / "events.jsonl").write_bytes(b"".join(whole[:5]))

    def run():
        query = spark.readStream.format("campaign_events").load(str(grown)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r[0] + str(r[1]) for r in spark.read.parquet(f"{tmp_path}/out").select("campaign_id", "campaign_position").collect())

    assert run() == [f"c1{k}" for k in range(1, 6)]
    (grown / "c1" / "events.jsonl").write_bytes(b"".join(whole))
    shutil.copytree(tmp_path / "all" / "c3", grown / "c3")
    assert run() == sorted([f"c1{k}" for k in range(1, 13)] + [f"c3{k}" for k in range(1, 11)])
    assert run() == run()


def test_every_fault_of_a_bundle_is_named(spark, tmp_path):
    names = [f"c{i:02d}" for i in range(14)]
    campaigns, events, observations, metrics, objects = tables(spark, names, [2] * 14)
    more = lambda f: f.where("campaign_id = 'c00'").drop("campaign_id").crossJoin(spark.createDataFrame([(n,) for n in names[2:]], "campaign_id string")).unionByName(f)
    write(spark, tmp_path, campaigns, events, more(observations), metrics, more(objects))
    assert bundles.faults(spark, str(tmp_path)).collect() == []

    def manifest(name, redigest=True, **changes):
        path = tmp_path / name / "manifest.json"
        said = json.loads(path.read_bytes()) | changes
        if redigest:
            said["manifest_digest"] = bundles.digest({k: v for k, v in said.items() if k != "manifest_digest"})
        path.write_bytes(bundles.file_bytes(said))

    (tmp_path / "c01" / "manifest.json").unlink()
    (tmp_path / "c02" / "manifest.json").write_text("[1]")
    manifest("c03", schema_version=9)
    manifest("c04", files_digest="0")
    (tmp_path / "c05" / "metrics.json").unlink()
    with (tmp_path / "c06" / "events.jsonl").open("ab") as file:
        file.write(b"\n")
    data = (tmp_path / "c07" / "events.jsonl").read_bytes()
    (tmp_path / "c07" / "events.jsonl").write_bytes(b"X" + data[1:])
    (tmp_path / "c08" / "notes.txt").write_text("x")
    manifest("c09", redigest=False, campaign_name="other")
    manifest("c10", event_stream_completeness="legacy_incomplete")
    manifest("c11", objects_digest="0")
    said = json.loads((tmp_path / "c12" / "manifest.json").read_bytes())["objects"][:1]
    manifest("c12", objects=said, objects_digest=bundles.digest(said))
    found = {(r.campaign_id, r.code, r.subject) for r in bundles.faults(spark, str(tmp_path)).collect()}
    assert found == {
        ("c01", "manifest_missing", None), ("c02", "manifest_invalid", None), ("c03", "manifest_unsupported", None), ("c04", "files_digest_mismatch", None), ("c05", "member_missing", "metrics.json"), ("c06", "member_size_mismatch", "events.jsonl"),
        ("c07", "member_sha256_mismatch", "events.jsonl"), ("c08", "unexpected_member", "notes.txt"), ("c09", "manifest_digest_mismatch", None), ("c10", "identity_invalid", None), ("c11", "objects_digest_mismatch", None), ("c12", "object_reference_mismatch", "o2|a2"),
    }
    assert [c for _, c, _ in sorted(found, key=str)] == list(bundles.FAULTS)
