"""Campaign bundles as a Spark sink and source.

A bundle is a folder named by its campaign: events.jsonl in the order of
positions, observations.json and metrics.json, and a manifest with the digest
of each. ``BundleSink`` writes one for each campaign in the tasks and shows
all of them at once when the job commits; ``CampaignEvents`` reads the event
streams back, in batch or as a stream, behind the contract's version gate.
Neither passes rows through the driver. Paths are local or URIs that
``pyarrow.fs`` knows."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyarrow import fs as filesystems
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from galvanite.functions.naming import admissible
from galvanite.sources.archives import opened
from galvanite.sources.packages import MANIFEST, file_bytes

EVENTS, OBSERVATIONS, METRICS = "events.jsonl", "observations.json", "metrics.json"
MEMBERS = (EVENTS, OBSERVATIONS, METRICS)
BUNDLE_VERSION = 2
#: What each purpose may read: contract versions 0 legacy, 1 readable, 2 complete.
PURPOSES = {"replay": (2,), "stream": (1, 2), "export": (0, 1, 2)}
LINES = "campaign_id string, part int, ordinal long, tie string, line string"
#: Parts of a bundle's rows: what the manifest says of the campaign, the members, the inventory of objects.
ABOUT, OBJECTS = 0, 4
EVENT_FIELDS = "campaign_id string, campaign_position long, event_id string, aggregate_type string, aggregate_id string, sequence long, event_type string, schema_version int, occurred_at string, recorded_at string, correlation_id string, causation_id string, idempotency_key string, payload string, contract_version int"


def bundle_lines(campaigns: DataFrame, events: DataFrame, observations: DataFrame, metrics: DataFrame, objects: DataFrame) -> DataFrame:
    """The rows of all bundles, as ``BundleSink`` takes them: each campaign's
    lie in one partition, in order.

    ``campaigns`` has campaign_id, campaign_name, environment_id, data_origin,
    execution_mode and event_stream_contract_version; a campaign without a
    row there has no bundle. The others have campaign_id and are ordered by
    campaign_position, by (observation_id, attempt_id), by metric_id and by
    (observation_id, attempt_id, object_uri). All their columns are written,
    payload as the JSON that it holds."""

    def lines(rows: DataFrame, part: int, ordinal: Column | None, *tie: str) -> DataFrame:
        body = F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns) if not (part == OBJECTS and c == "campaign_id"))), {"ignoreNullFields": "false"})
        order = ordinal if ordinal is not None else F.lit(0)
        return rows.select(F.col("campaign_id").cast("string").alias("campaign_id"), F.lit(part).alias("part"), order.cast("long").alias("ordinal"), F.concat_ws("\u0001", *(F.col(c).cast("string") for c in tie)).alias("tie"), body.alias("line"))

    pair = ("observation_id", "attempt_id")
    out = lines(campaigns, ABOUT, None)
    for more in (lines(events, 1, F.col("campaign_position"), "event_id"), lines(observations, 2, None, *pair), lines(metrics, 3, None, "metric_id"), lines(objects, OBJECTS, None, *pair, "object_uri")):
        out = out.unionByName(more)
    return out.repartition("campaign_id").sortWithinPartitions("campaign_id", "part", "ordinal", "tie")


def _where(path: str) -> tuple[filesystems.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return filesystems.FileSystem.from_uri(path)
    return filesystems.LocalFileSystem(), path


class _Member:
    """A file that is hashed while it is written."""

    def __init__(self, fs: filesystems.FileSystem, path: str):
        self.stream, self.digest, self.size, self.rows = fs.open_output_stream(path), hashlib.sha256(), 0, 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)


def _event_line(row: dict) -> bytes:
    """One event, its payload as an object."""
    if isinstance(row.get("payload"), str):
        row["payload"] = json.loads(row["payload"])
    return json.dumps(row, sort_keys=True, ensure_ascii=False).encode()


def _list_item(row: dict, first: bool) -> bytes:
    """One row of a list, laid out as ``file_bytes`` lays out the whole list."""
    text = json.dumps(row, indent=2, sort_keys=True, ensure_ascii=False)
    return (("[\n  " if first else ",\n  ") + text.replace("\n", "\n  ")).encode()


def digest(value: object) -> str:
    return hashlib.sha256(file_bytes(value)).hexdigest()


def manifest_of(about: dict, files: list[dict], objects: list[dict], generated_at: str) -> dict:
    version = about.get("event_stream_contract_version")
    out = {k: about.get(k) for k in ("campaign_id", "campaign_name", "environment_id", "data_origin", "execution_mode", "event_stream_contract_version")}
    out |= {"schema_version": BUNDLE_VERSION, "event_stream_completeness": "complete" if version in (1, 2) else "legacy_incomplete", "generated_at": generated_at, "files": files, "objects": objects, "files_digest": digest(files), "objects_digest": digest(objects)}
    return out | {"manifest_digest": digest(out)}


@dataclass
class Written(WriterCommitMessage):
    folder: str
    campaigns: list[str]


class _BundleWriter(DataSourceWriter):
    def __init__(self, path: str, generated_at: str):
        self.path, self.generated_at, self.job = path.rstrip("/"), generated_at, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = _where(self.path)
        folder, campaigns = f"_writing/{self.job}/{uuid.uuid4().hex}", []
        now = None
        for row in rows:
            if now is None or row.campaign_id != now.campaign:
                campaigns += self._end(now)
                now = _Bundle(fs, f"{root}/{folder}", row.campaign_id)
            now.add(row.part, json.loads(row.line))
        campaigns += self._end(now)
        return Written(folder, campaigns)

    def _end(self, bundle: _Bundle | None) -> list[str]:
        return [bundle.campaign] if bundle is not None and bundle.end(self.generated_at) else []

    def commit(self, messages: list[Written | None]) -> None:
        """Names only: the tasks' folders become the campaigns'."""
        fs, root = _where(self.path)
        moves = [(f"{root}/{m.folder}/{c}", f"{root}/{c}") for m in messages if m for c in m.campaigns]
        taken = [to for _, to in moves if fs.get_file_info(to).type != filesystems.FileType.NotFound]
        if taken:
            self.abort(messages)
            raise FileExistsError(f"destination exists: {taken[0]}")
        for source, target in moves:
            fs.move(source, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _where(self.path)
        if fs.get_file_info(f"{root}/_writing/{self.job}").type != filesystems.FileType.NotFound:
            fs.delete_dir(f"{root}/_writing/{self.job}")


class _Bundle:
    """One campaign's bundle while it is written. Only its inventory of
    objects is held in memory, for the manifest."""

    def __init__(self, fs: filesystems.FileSystem, folder: str, campaign: str):
        if not campaign or "/" in campaign or campaign.startswith((".", "_")):
            raise ValueError(f"no folder can have the name {campaign!r}")
        self.fs, self.folder, self.campaign, self.about, self.objects = fs, f"{folder}/{campaign}", campaign, None, []
        fs.create_dir(self.folder)
        self.members = [_Member(fs, f"{self.folder}/{name}") for name in MEMBERS]

    def add(self, part: int, row: dict) -> None:
        if part == ABOUT:
            self.about = row
        elif part == OBJECTS:
            self.objects.append(row)
        else:
            member = self.members[part - 1]
            member.write(_event_line(row) + b"\n" if part == 1 else _list_item(row, not member.rows))
            member.rows += 1

    def end(self, generated_at: str) -> bool:
        files = []
        for name, member in zip(MEMBERS, self.members, strict=True):
            if name != EVENTS:
                member.write(b"\n]\n" if member.rows else b"[]\n")
            member.stream.close()
            files.append({"name": name, "sha256": member.digest.hexdigest(), "byte_size": member.size})
        if self.about is None:
            return False
        with self.fs.open_output_stream(f"{self.folder}/{MANIFEST}") as stream:
            stream.write(file_bytes(manifest_of(self.about, files, self.objects, generated_at)))
        return True


class BundleSink(DataSource):
    """``bundle_lines(...).write.format("campaign_bundles").option("generated_at",
    ...).mode("append").save(path)``: one folder for each campaign. Equal rows and
    generated_at give equal bytes. A job that fails leaves no bundle; one whose
    campaign has a bundle already is refused as a whole."""

    @classmethod
    def name(cls) -> str:
        return "campaign_bundles"

    def schema(self) -> str:
        return LINES

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("bundles are never overwritten")
        stamp = self.options.get("generated_at", "")
        if not stamp.endswith(("Z", "+00:00")):
            raise ValueError("generated_at must be a time in UTC")
        return _BundleWriter(self.options["path"], stamp)


def folders_in(path: str) -> list[str]:
    """The campaigns that have a folder under a path."""
    fs, root = _where(path)
    return [f.base_name for f in fs.get_file_info(filesystems.FileSelector(root)) if f.type == filesystems.FileType.Directory and not f.base_name.startswith(("_", "."))]


def campaigns_in(path: str) -> dict[str, int]:
    """The campaigns with a bundle under a path, with the bytes of their events."""
    fs, root = _where(path)
    named = folders_in(path)
    files = fs.get_file_info([f"{root}/{c}/{EVENTS}" for c in named])
    return {c: e.size for c, e in zip(named, files, strict=True) if e.type == filesystems.FileType.File}


@dataclass
class Streams(InputPartition):
    """Campaigns of one task, with the range of bytes of each."""

    ranges: list[tuple[str, int, int]]


def _dealt(ranges: list[tuple[str, int, int]], most: int) -> list[Streams]:
    """Ranges dealt to at most ``most`` partitions of about equal bytes; a
    campaign stays whole, as its order does."""
    parts = [Streams([]) for _ in range(max(1, min(most, len(ranges))))]
    loads = [0] * len(parts)
    for one in sorted(ranges, key=lambda r: (r[1] - r[2], r[0])):
        k = loads.index(min(loads))
        parts[k].ranges.append(one)
        loads[k] += one[2] - one[1]
    return [p for p in parts if p.ranges]


class _Events:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("partitions", "200"))
        self.purpose = options.get("purpose", "replay")
        if self.purpose not in PURPOSES:
            raise ValueError(f"purpose must be one of {', '.join(PURPOSES)}")

    def read(self, partition: Streams) -> Iterator[tuple]:
        fs, root = _where(self.path)
        for campaign, start, end in partition.ranges:
            with fs.open_input_stream(f"{root}/{campaign}/{MANIFEST}") as stream:
                version = json.loads(stream.read()).get("event_stream_contract_version")
            if version not in PURPOSES[self.purpose]:
                raise ValueError(f"legacy_stream: campaign {campaign} has contract version {version}, which {self.purpose} refuses")
            yield from self._lines(fs, f"{root}/{campaign}/{EVENTS}", campaign, start, end, version)

    def _lines(self, fs: filesystems.FileSystem, path: str, campaign: str, start: int, end: int, version: int) -> Iterator[tuple]:
        """The events whose lines start in [start, end); positions must not leave a gap."""
        last = None
        with io.BufferedReader(fs.open_input_file(path)) as stream:
            at = start
            if start:
                stream.seek(start - 1)
                at += len(stream.readline()) - 1
            while at < end:
                line = stream.readline()
                at += len(line)
                if not line.endswith(b"\n"):
                    raise ValueError(f"{path} ends inside a line")
                row = json.loads(line)
                position = row.get("campaign_position")
                if self.purpose != "export" and position != (last + 1 if last is not None else position if start else 1):
                    raise ValueError(f"campaign_position_gap: campaign {campaign} has {position} after {last or 0}")
                last = position
                payload = row.get("payload")
                text = None if payload is None else json.dumps(payload, sort_keys=True, ensure_ascii=False)
                yield (campaign, *(row.get(f.split()[0]) for f in EVENT_FIELDS.split(", ")[1:-2]), text, version)


class _Batch(_Events, DataSourceReader):
    wanted: set[str] | None = None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            own = f.attribute == ("campaign_id",) if isinstance(f, EqualTo | In) else False
            if own:
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            else:
                yield f

    def partitions(self) -> list[Streams]:
        sizes = campaigns_in(self.path)
        return _dealt([(c, 0, n) for c, n in sizes.items() if self.wanted is None or c in self.wanted], self.most)


class _Stream(_Events, DataSourceStreamReader):
    """Offsets are the bytes of each campaign's events that were read."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return campaigns_in(self.path)

    def partitions(self, start: dict, end: dict) -> list[Streams]:
        return _dealt([(c, start.get(c, 0), n) for c, n in end.items() if n > start.get(c, 0)], self.most)

    def commit(self, end: dict) -> None:
        pass


class CampaignEvents(DataSource):
    """``spark.read.format("campaign_events").load(path)`` and ``readStream``:
    events of all bundles, each campaign's in order within one partition.

    ``purpose`` decides which contract versions are read: replay takes only
    complete streams (2), stream also readable ones (1), export all of them,
    legacy rows without positions included; any other is an error, and so is
    a gap of positions, but for export. Equality and IN on campaign_id prune
    the campaigns whose files are opened (spark.sql.python.filterPushdown.enabled).
    A stream reads what has been appended to a campaign's events since."""

    @classmethod
    def name(cls) -> str:
        return "campaign_events"

    def schema(self) -> str:
        return EVENT_FIELDS

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BundleSink)
    spark.dataSource.register(CampaignEvents)


#: What can be wrong with a bundle, in the order of its checks.
FAULTS = (
    "manifest_missing", "manifest_invalid", "manifest_unsupported", "files_digest_mismatch", "member_missing", "member_size_mismatch", "member_sha256_mismatch", "unexpected_member",
    "manifest_digest_mismatch", "identity_invalid", "objects_digest_mismatch", "object_reference_mismatch",
)
_FILES = "array<struct<name:string,sha256:string,byte_size:long>>"
_MANIFEST = f"schema_version int, campaign_id string, environment_id string, data_origin string, execution_mode string, event_stream_contract_version int, event_stream_completeness string, generated_at string, files {_FILES}, objects array<struct<observation_id:string,attempt_id:string,object_uri:string>>, files_digest string, objects_digest string, manifest_digest string"


def _listed(path: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _where(path)
        for batch in batches:
            found = [(c, f"{path.rstrip('/')}/{c}/{f.base_name}", f.base_name, f.size) for c in batch["campaign_id"] for f in fs.get_file_info(filesystems.FileSelector(f"{root}/{c}")) if f.type == filesystems.FileType.File]
            yield pd.DataFrame(found, columns=["campaign_id", "path", "name", "byte_size"])

    return work


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each file, a piece at a time."""
    for batch in batches:
        digests = []
        for path in batch["path"]:
            own = hashlib.sha256()
            with opened(path) as file:
                while piece := file.read(1 << 20):
                    own.update(piece)
            digests.append(own.hexdigest())
        yield batch.assign(sha256=digests)


def _redigested(texts: pd.Series) -> pd.DataFrame:
    """The digests that a manifest should name, or nulls if it is no object."""
    rows = []
    for text in texts:
        try:
            said = json.loads(text)
            rows.append((digest(said["files"]), digest(said["objects"]), digest({k: v for k, v in said.items() if k != "manifest_digest"})))
        except (ValueError, TypeError, KeyError):
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["files", "objects", "whole"])


def faults(spark: SparkSession, root: str) -> DataFrame:
    """(campaign_id, rank, code, subject) of everything that is wrong with the
    bundles under ``root``; sound ones give no row. The first fault of a
    bundle is its least rank.

    The driver lists the folders' names; files are listed and digests computed,
    a piece at a time, in the tasks; only manifests and the identities of observations
    become rows."""
    folders = spark.createDataFrame([(c,) for c in folders_in(root)], "campaign_id string")
    files = folders.repartition("campaign_id").mapInPandas(_listed(root), "campaign_id string, path string, name string, byte_size long")
    members = files.where(F.col("name") != MANIFEST).repartition("path").mapInPandas(_hashed, "campaign_id string, path string, name string, byte_size long, sha256 string").drop("path")
    held = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/[!_.]*/{MANIFEST}").select(F.element_at(F.split("path", "/"), -2).alias("campaign_id"), F.decode("content", "utf-8").alias("text"))
    texts = files.where(F.col("name") == MANIFEST).select("campaign_id").join(held, "campaign_id", "left").na.fill({"text": ""})
    manifests = texts.select("campaign_id", F.from_json("text", _MANIFEST).alias("m"), F.pandas_udf(_redigested, "files string, objects string, whole string")("text").alias("d"))
    valid = manifests.where("d.whole is not null and m.files is not null")
    fault = lambda rows, code, subject=None: rows.select("campaign_id", F.lit(FAULTS.index(code)).alias("rank"), F.lit(code).alias("code"), (F.col(subject) if subject else F.lit(None)).cast("string").alias("subject"))
    known = valid.where(F.col("m.schema_version") == BUNDLE_VERSION)
    declared = known.select("campaign_id", F.explode("m.files").alias("f")).select("campaign_id", F.col("f.name").alias("name"), F.col("f.sha256").alias("_sha"), F.col("f.byte_size").alias("_size"), F.lit(True).alias("_declared"))
    both = declared.join(members.join(known.select("campaign_id"), "campaign_id", "left_semi"), ["campaign_id", "name"], "full_outer")
    said = F.col("m")
    version, complete = said["event_stream_contract_version"], said["event_stream_completeness"]
    marker = (version.isNull() & complete.isNull()) | (version.isin(0, 1, 2) & (complete == F.when(version.isin(1, 2), "complete").otherwise("legacy_incomplete")))
    identity = (said["campaign_id"] == F.col("campaign_id")) & (said["environment_id"] != "") & admissible(said["data_origin"], said["execution_mode"]) & marker & said["generated_at"].rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    pair = ["campaign_id", "observation_id", "attempt_id"]
    kept = known.select("campaign_id", F.explode("m.objects").alias("o")).select("campaign_id", "o.observation_id", "o.attempt_id").distinct().withColumn("_kept", F.lit(True))
    rows = spark.read.option("multiLine", True).schema("observation_id string, attempt_id string").json(f"{root.rstrip('/')}/[!_.]*/{OBSERVATIONS}").withColumn("campaign_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    seen = rows.join(known.select("campaign_id"), "campaign_id", "left_semi").groupBy(*pair).agg(F.count("*").alias("_n"))
    refers = seen.join(kept, pair, "full_outer").where("_n is null or _kept is null or _n > 1 or observation_id is null").withColumn("_who", F.concat_ws("|", "observation_id", "attempt_id"))
    missing = folders.join(texts.select("campaign_id"), "campaign_id", "left_anti")
    out = (
        fault(missing, "manifest_missing"), fault(manifests.where("d.whole is null or m.files is null"), "manifest_invalid"), fault(valid.where(~said["schema_version"].eqNullSafe(BUNDLE_VERSION)), "manifest_unsupported"),
        fault(known.where(~F.col("d.files").eqNullSafe(said["files_digest"])), "files_digest_mismatch"), fault(both.where("sha256 is null"), "member_missing", "name"),
        fault(both.where("_declared and sha256 is not null and not (byte_size <=> _size)"), "member_size_mismatch", "name"), fault(both.where("_declared and byte_size <=> _size and not (sha256 <=> _sha)"), "member_sha256_mismatch", "name"),
        fault(both.where("_declared is null"), "unexpected_member", "name"), fault(known.where(~F.col("d.whole").eqNullSafe(said["manifest_digest"])), "manifest_digest_mismatch"),
        fault(known.where(~F.coalesce(identity, F.lit(False))), "identity_invalid"), fault(known.where(~F.col("d.objects").eqNullSafe(said["objects_digest"])), "objects_digest_mismatch"),
        fault(refers, "object_reference_mismatch", "_who"),
    )
    return reduce(DataFrame.unionByName, out)
