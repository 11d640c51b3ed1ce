"""Listings of remote records, chosen files, locations and origins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.functions.naming import checksum_parts, unsafe_filename

#: Files that say where a root's bytes come from, and their origin.
FIXTURE, PROVENANCE = "fixture_manifest.json", "provenance.json"
RECORD = "doi string, id string, revision long, conceptdoi string, metadata struct<title:string,publication_date:string,access_right:string,license:struct<id:string>,relations:struct<version:array<struct<index:long>>>>, files array<struct<key:string,size:long,checksum:string,links:struct<self:string>>>"


def record_files(records: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each file that a record (JSON text) lists: key, doi,
    record_version, filename, byte_size, algorithm, digest and problem. A
    record that lacks what it must have is one row with its problem; unknown
    fields are ignored, and nothing is filled in."""
    read = records.select(key, F.from_json(text, RECORD).alias("r"))
    version = F.get(F.col("r.metadata.relations.version"), F.lit(0))["index"]
    problem = F.when(F.col("r").isNull() | F.col("r.doi").isNull() | F.col("r.id").isNull() | F.col("r.metadata.title").isNull(), "not_a_record").when(version.isNull(), "no_version").when(F.col("r.files").isNull(), "no_files")
    flat = read.select(key, F.col("r.doi").alias("doi"), version.cast("string").alias("record_version"), problem.alias("_whole"), F.explode_outer(F.when(problem.isNull(), F.col("r.files"))).alias("f"))
    sums = checksum_parts(F.col("f.checksum"))
    own = F.coalesce("_whole", F.when(F.col("f").isNull(), F.lit(None)).otherwise(F.coalesce(unsafe_filename(F.col("f.key")), sums["problem"], F.when(F.col("f.size").isNull() | F.col("f.links.self").isNull(), "incomplete_file"))))
    return flat.select(key, "doi", "record_version", F.col("f.key").alias("filename"), F.col("f.size").alias("byte_size"), sums["algorithm"].alias("algorithm"), sums["digest"].alias("digest"), own.alias("problem"))


def selected(files: DataFrame, wanted: list[str], most: int, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(position, filename, byte_size, problem): files asked for by name, in
    the order asked; an unknown name or a file above ``most`` bytes that
    isn't allowed is a problem, never left out."""
    asked = files.sparkSession.createDataFrame([(i, n) for i, n in enumerate(wanted)], "position int, filename string")
    found = asked.join(files.select("filename", "byte_size"), "filename", "left")
    large = (F.col("byte_size") > most) & ~F.col("filename").isin(*allowed) if allowed else F.col("byte_size") > most
    problem = F.when(F.col("byte_size").isNull(), "not_listed").when(large, "too_large")
    return found.select("position", "filename", "byte_size", problem.alias("problem")).orderBy("position")


def origins(members: DataFrame, root: str, name: str) -> DataFrame:
    """(root, data_origin, problem) by the evidence among a root's files: a
    fixture manifest makes it synthetic, a provenance record observed; both
    or neither decide nothing."""
    has = lambda what: F.bool_or(F.col(name) == what)
    rows = members.groupBy(root).agg(has(FIXTURE).alias("f"), has(PROVENANCE).alias("p"))
    problem = F.when(F.col("f") & F.col("p"), "ambiguous_root").when(~F.col("f") & ~F.col("p"), "unknown_root")
    return rows.select(root, F.when(problem.isNull(), F.when(F.col("f"), "synthetic").otherwise("observed")).alias("data_origin"), problem.alias("problem"))


def locations(index: DataFrame) -> DataFrame:
    """Known places in order: by library, then by the area's number."""
    return index.select("library_id", "area_id").distinct().orderBy("library_id", F.col("area_id").cast("int"))


def skipped(members: DataFrame, path: str) -> DataFrame:
    """(path, reason) of archive members that aren't read as tables."""
    name = F.col(path)
    fork = name.startswith("__MACOSX/") | name.contains("/__MACOSX/")
    reason = F.when(fork, "resource_fork").when(~F.lower(name).rlike(r"[^/]\.(csv|txt|dat|tsv)$"), "not_delimited_text")
    return members.select(path, reason.alias("reason")).where("reason is not null")
