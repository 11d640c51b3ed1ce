"""Objects stored under their digests, written and read back by tasks.

An object lies at ``root/ab/abcd...``, where abcd... is its SHA-256. Only the
files that are asked for are opened, and nothing is used before its bytes have
been hashed again."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame

STORED = "sha256 string, byte_size long, object_uri string, problem string"
FETCHED = "object_uri string, content binary, problem string"


def _store(root: str) -> tuple[filesystems.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return filesystems.FileSystem.from_uri(root)
    return filesystems.LocalFileSystem(), root


def _at(root: str, digest: str) -> str:
    return f"{root.rstrip('/')}/{digest[:2]}/{digest}"


def put_verified(objects: DataFrame, root: str) -> DataFrame:
    """Stores each ``content`` under its digest and reads it back: STORED, one
    row for each row. Equal contents are stored once; one that doesn't read
    back as written has problem read_back_differs. A task that is run again
    writes the same files."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _store(root)
        for batch in batches:
            rows = []
            for content in batch["content"]:
                if content is None:
                    rows.append((None, None, None, "no_content"))
                    continue
                content = bytes(content)
                digest = hashlib.sha256(content).hexdigest()
                target = _at(base, digest)
                if fs.get_file_info(target).type == filesystems.FileType.NotFound:
                    fs.create_dir(target.rsplit("/", 1)[0])
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as out:
                        out.write(content)
                    fs.move(part, target)
                same = _digest_of(fs, target, len(content)) == (digest, len(content))
                rows.append((digest, len(content), _at(root, digest), None if same else "read_back_differs"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STORED.split(", ")])

    return objects.select("content").mapInPandas(put, STORED)


def _digest_of(fs: filesystems.FileSystem, path: str, most: int) -> tuple[str, int]:
    """Digest and size of a file, read up to one piece beyond ``most`` bytes."""
    own, size = hashlib.sha256(), 0
    with fs.open_input_stream(path) as file:
        while size <= most and (piece := file.read(1 << 20)):
            own.update(piece)
            size += len(piece)
    return own.hexdigest(), size


def fetch_verified(requests: DataFrame, root: str, *, content: bool = True) -> DataFrame:
    """Looks up objects (object_uri, byte_size, sha256): FETCHED, with the
    content of those that are as recorded. A row whose file is absent, or has
    another size or digest, is refused: problem object_missing, size_mismatch
    or checksum_mismatch, and no content; outside_store if its uri isn't the
    place that its digest names. Nulls are object_missing."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _store(root)
        for batch in batches:
            rows = []
            for uri, size, digest in zip(batch["object_uri"], batch["byte_size"], batch["sha256"], strict=True):
                data, problem = None, None
                if uri is None or digest is None or pd.isna(size):
                    problem = "object_missing"
                elif uri != _at(root, digest):
                    problem = "outside_store"
                elif fs.get_file_info(_at(base, digest)).type != filesystems.FileType.File:
                    problem = "object_missing"
                elif fs.get_file_info(_at(base, digest)).size != int(size):
                    problem = "size_mismatch"
                else:
                    with fs.open_input_stream(_at(base, digest)) as file:
                        data = file.read()
                    if hashlib.sha256(data).hexdigest() != digest:
                        data, problem = None, "checksum_mismatch"
                rows.append((uri, data if content else None, problem))
            yield pd.DataFrame(rows, columns=["object_uri", "content", "problem"])

    return requests.select("object_uri", "byte_size", "sha256").mapInPandas(fetch, FETCHED)
