"""Evidence packages: deterministic archives with a closed manifest.

Writing is a driver job by nature (one file), fed row by row, so it suits a
package's size and not a corpus. Verifying many packages is a Spark job."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.operators.evidence import checksum_audit
from galvanite.sources.archives import members, unsafe

MANIFEST = "manifest.json"
#: Fixed value: the time of every member, so that equal contents give equal bytes.
MEMBER_TIME = (1980, 1, 1, 0, 0, 0)


def file_bytes(value: object) -> bytes:
    """The layout of files for readers; identities use canonical bytes."""
    return (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n").encode()


def json_lines(rows: DataFrame, *order: str) -> bytes:
    """Rows as JSON lines in order, read from Spark partition by partition."""
    ordered = rows.orderBy(*order).select(F.to_json(F.struct(*sorted(rows.columns))).alias("line"))
    return b"".join(r["line"].encode() + b"\n" for r in ordered.toLocalIterator())


def package(contents: Mapping[str, bytes]) -> bytes:
    """A ZIP of the members by name and a manifest of their digests."""
    listed = [{"path": name, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data)} for name, data in sorted(contents.items(), key=lambda x: (x[0].casefold(), x[0]))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, data in sorted({**contents, MANIFEST: file_bytes({"members": listed})}.items()):
            info = zipfile.ZipInfo(name, MEMBER_TIME)
            info.compress_type = zipfile.ZIP_DEFLATED
            box.writestr(info, data)
    return out.getvalue()


def bundle(events: DataFrame, observations: DataFrame, metrics: DataFrame) -> bytes:
    """One campaign's bundle: its events in the order of their positions, its
    observations and metrics in the order of their identities, a manifest."""
    return package({
        "events.jsonl": json_lines(events, "campaign_position"),
        "observations.jsonl": json_lines(observations, "observation_id", "attempt_id"),
        "metrics.jsonl": json_lines(metrics, "metric_id"),
    })


def publish(data: bytes, target: Path) -> None:
    """Writes beside the target and renames: readers see all or nothing."""
    part = target.with_name(target.name + ".part")
    part.write_bytes(data)
    os.replace(part, target)


def verify(packages: DataFrame) -> DataFrame:
    """(path, member, problem) for packages (path, content): unsafe archives,
    members that can't be read, and members that the manifest misses, doesn't
    know, or whose bytes differ. Sound packages give no rows. Limits are
    checked before anything is unpacked."""
    found = members(packages)
    refused = unsafe(found)
    damaged = found.where("problem = 'unreadable_member'").select("path", "member", "problem")
    fine = found.join(refused, "path", "left_anti").where("problem is null")
    manifests = fine.where(F.col("member") == MANIFEST).select("path", F.from_json(F.decode("content", "utf-8"), "members array<struct<path:string,sha256:string,size:long>>").alias("m"))
    key = lambda member: F.concat_ws("\n", "path", member)
    declared = manifests.select("path", F.explode("m.members").alias("d")).select(key(F.col("d.path")).alias("key"), F.col("d.size").alias("size"), F.col("d.sha256").alias("sha256"))
    seen = fine.where(F.col("member") != MANIFEST).select(key(F.col("member")).alias("key"), F.col("size"), F.sha2("content", 256).alias("sha256"))
    audit = checksum_audit(declared, seen, "key").select(F.split("key", "\n")[0].alias("path"), F.split("key", "\n")[1].alias("member"), "problem")
    none = fine.select("path").distinct().join(manifests.select("path"), "path", "left_anti").select("path", F.lit(MANIFEST).alias("member"), F.lit("missing").alias("problem"))
    known = audit.join(damaged.select("path", "member"), ["path", "member"], "left_anti")  # a damaged member isn't missing as well
    return refused.select("path", F.lit(None).cast("string").alias("member"), "problem").unionByName(damaged).unionByName(known.select("path", "member", "problem")).unionByName(none)


def put_verified(root: Path, data: bytes) -> str:
    """Stores bytes under their digest and reads them back; equal bytes are
    stored once."""
    digest = hashlib.sha256(data).hexdigest()
    target = root / digest
    if not target.exists():
        publish(data, target)
    if hashlib.sha256(target.read_bytes()).hexdigest() != digest:
        raise OSError(f"{target} doesn't hold what was written")
    return digest
