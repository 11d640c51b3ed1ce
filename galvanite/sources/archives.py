"""Members of ZIP archives and what their names say."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of sweep members: library, area, x and y.
SWEEP = r"^SECCM_dataset/Au-Ir-Rh_([A-Za-z]+-rich)_SECCM_area_(\d+)_x=(-?\d+\.\d+)_y=(-?\d+\.\d+)_LSV\.csv$"
#: Names that leave their folder.
UNSAFE_NAME = r"(^|/)\.\.(/|$)|^/|\\|^[A-Za-z]:"
FIT_MEMBER = "SECCM_dataset/LSV_fit_parameters.csv"
#: A sweep member's columns.
SWEEP_HEADER = ("Potential vs. RHE [V]", "Current density [A/cm^2]", "Standard deviation [A/cm^2]")


#: What reading a damaged, encrypted or oddly packed member raises.
_UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError)
MEMBERS = "path string, at int, member string, size long, packed long, content binary, problem string"


def refusal(infos: list[zipfile.ZipInfo], most_members: int, most_bytes: int, most_ratio: int) -> str | None:
    """Why an archive is refused, from its directory alone, or None."""
    names = [i.filename for i in infos]
    if len(infos) > most_members:
        return "too_many_members"
    if any(re.search(UNSAFE_NAME, n) for n in names):
        return "unsafe_name"
    if len(set(names)) < len(names):
        return "duplicate_member"
    if sum(i.file_size for i in infos) > most_bytes:
        return "too_large"
    if any(i.file_size > most_ratio * max(1, i.compress_size) for i in infos):
        return "ratio_too_high"
    return None


def members(archives: DataFrame, content: bool = True, *, most_members: int = 1000, most_bytes: int = 1 << 30, most_ratio: int = 200) -> DataFrame:
    """(path, at, member, size, packed, content, problem) of every file in
    every archive (path, content), one at a time.

    Nothing is unpacked before an archive's directory has passed the limits
    of ``unsafe``: a refused one has its rows without content. An archive that
    can't be opened has one row with a null member and problem unreadable; a
    member that can't be read (damaged, encrypted, unknown packing) has a row
    with problem unreadable_member. No archive fails the job."""
    names = [c.split()[0] for c in MEMBERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    box = zipfile.ZipFile(io.BytesIO(raw or b""))
                except _UNREADABLE:
                    yield pd.DataFrame([(path, None, None, None, None, None, "unreadable")], columns=names)
                    continue
                infos = [(at, i) for at, i in enumerate(box.infolist()) if not i.is_dir()]
                fine = refusal([i for _, i in infos], most_members, most_bytes, most_ratio) is None
                for at, info in infos:
                    data = problem = None
                    if content and fine:
                        try:
                            data = box.read(info)
                        except _UNREADABLE:
                            problem = "unreadable_member"
                    yield pd.DataFrame([(path, at, info.filename, info.file_size, info.compress_size, data, problem)], columns=names)

    return archives.select("path", "content").mapInPandas(run, MEMBERS)


def opened(path: str) -> io.BufferedReader:
    """A file of any store that ``pyarrow.fs`` knows, for reading at places."""
    if "://" in path or path.startswith("file:"):
        fs, path = filesystems.FileSystem.from_uri(path)
    else:
        fs = filesystems.LocalFileSystem()
    return io.BufferedReader(fs.open_input_file(path))


LISTED = "path string, at int, member string, size long, packed long, fine boolean, range long, problem string"


def listed(paths: DataFrame, *, range_bytes: int = 64 << 20, most_members: int = 1000, most_bytes: int = 1 << 30, most_ratio: int = 200) -> DataFrame:
    """The directory of each archive (one column, path), read from its end:
    LISTED. ``range`` numbers runs of members of about ``range_bytes`` packed
    bytes, ``fine`` is false for archives that the limits refuse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with opened(path) as file, zipfile.ZipFile(file) as box:
                        infos = [(at, i) for at, i in enumerate(box.infolist()) if not i.is_dir()]
                except _UNREADABLE:
                    yield pd.DataFrame([(path, None, None, None, None, False, 0, "unreadable")], columns=names)
                    continue
                fine = refusal([i for _, i in infos], most_members, most_bytes, most_ratio) is None
                rows, before = [], 0
                for at, i in infos:
                    rows.append((path, at, i.filename, i.file_size, i.compress_size, fine, before // range_bytes, None))
                    before += i.compress_size
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in LISTED.split(", ")]
    return paths.select("path").mapInPandas(run, LISTED)


def members_at(paths: DataFrame, *, range_bytes: int = 64 << 20, **limits: int) -> DataFrame:
    """As ``members``, for archives that lie at ``path`` instead of in a row.

    Directories are read first, and then each task reads the members of its
    ranges where they lie, so an archive of any size is neither a row nor a
    task; a member is a row, and so limited by ``most_bytes``."""
    found = listed(paths, range_bytes=range_bytes, **limits)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, file, box = None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                data, problem = None, row.problem
                if row.fine:
                    try:
                        if row.path != now:
                            if file is not None:
                                file.close()
                            now, file = row.path, opened(row.path)
                            box = zipfile.ZipFile(file)
                        data = box.read(box.infolist()[int(row.at)])
                    except _UNREADABLE:
                        problem = "unreadable_member"
                whole = lambda x: None if pd.isna(x) else int(x)
                yield pd.DataFrame([(row.path, whole(row.at), row.member, whole(row.size), whole(row.packed), data, problem)], columns=names)

    names = [c.split()[0] for c in MEMBERS.split(", ")]
    dealt = found.repartition("path", "range").sortWithinPartitions("path", "at")
    return dealt.mapInPandas(read, MEMBERS)


def sweep_index(found: DataFrame) -> DataFrame:
    """(path, library_id, area_id, member, grid_x, grid_y); of several
    members for a place the last counts."""
    part = lambda i: F.regexp_extract("member", SWEEP, i)
    named = found.where(F.col("member").rlike(SWEEP)).select("path", "at", "member", part(1).alias("library_id"), part(2).alias("area_id"), part(3).cast("decimal(18,9)").alias("grid_x"), part(4).cast("decimal(18,9)").alias("grid_y"))
    last = F.max(F.struct("at", "member", "grid_x", "grid_y")).alias("m")
    return named.groupBy("path", "library_id", "area_id").agg(last).select("path", "library_id", "area_id", "m.member", "m.grid_x", "m.grid_y")


def unmatched(found: DataFrame) -> DataFrame:
    """Members that no rule knows, for a changed layout to show."""
    return found.where(F.col("member").isNotNull() & ~F.col("member").rlike(SWEEP) & (F.col("member") != FIT_MEMBER)).select("path", "member")


def look_up(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates (library_id, area_id, ...) with their member, or the reason
    source_location_unavailable; nothing is interpolated."""
    joined = candidates.join(index.select("library_id", "area_id", "member", "grid_x", "grid_y"), ["library_id", "area_id"], "left")
    return joined.withColumn("failure_code", F.when(F.col("member").isNull(), "source_location_unavailable"))


def sweep_points(found: DataFrame) -> DataFrame:
    """(path, member, row_no, potential, current) of sweep members; a member
    with another header gives a row with problem unexpected_header. Lines
    may end in CR, LF or both; a cell that is no number is null."""
    text = F.regexp_replace(F.decode("content", "utf-8"), "^﻿", "")
    lines = found.where(F.col("member").rlike(SWEEP)).select("path", "member", F.split(text, r"\r\n|\n|\r").alias("lines"))
    fits = F.col("lines")[0] == F.lit(",".join(SWEEP_HEADER))
    flat = lines.select("path", "member", F.when(~fits, "unexpected_header").alias("problem"), F.posexplode(F.when(fits, F.slice("lines", 2, F.size("lines"))).otherwise(F.array(F.lit("-")))).alias("row_no", "line")).where("line <> ''")
    cell = lambda i: F.get(F.split("line", ","), F.lit(i)).try_cast("decimal(38,18)")
    return flat.select("path", "member", "problem", F.when(F.col("problem").isNull(), F.col("row_no")).alias("row_no"), cell(0).alias("potential"), cell(1).alias("current"))


def unsafe(found: DataFrame, *, most_members: int = 1000, most_bytes: int = 1 << 30, most_ratio: int = 200) -> DataFrame:
    """(path, problem): archives beyond the limits of count, size, ratio or
    with names that leave their folder. Sizes only, no content is needed."""
    bad_name = F.col("member").rlike(UNSAFE_NAME)
    sums = found.groupBy("path").agg(F.count("member").alias("n"), F.sum("size").alias("s"), F.max(F.col("size") / F.greatest("packed", F.lit(1))).alias("r"), F.bool_or(bad_name).alias("b"), F.count_distinct("member").alias("d"))
    problem = F.when(F.col("n") == 0, "unreadable").when(F.col("n") > most_members, "too_many_members").when(F.col("b"), "unsafe_name").when(F.col("d") < F.col("n"), "duplicate_member").when(F.col("s") > most_bytes, "too_large").when(F.col("r") > most_ratio, "ratio_too_high")
    return sums.withColumn("problem", problem).where("problem is not null").select("path", "problem")
