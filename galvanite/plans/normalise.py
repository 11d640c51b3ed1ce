"""From instrument files to identified series, a lineage graph and findings."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.canonical import content_id, flat_content_id
from galvanite.operators.evidence import unclosed
from galvanite.sources.delimited import Profile, Reader, delimited, parse, refusals, series

PARSER_VERSION = "1"


def profile_id(document: str) -> str:
    """Identity of an import profile document (JSON text): columns and
    missing tokens count as sets."""
    body = json.loads(document)
    body["columns"] = sorted(body["columns"], key=lambda c: c["source_column"])
    body["missing_value_tokens"] = sorted(body["missing_value_tokens"])
    kind = "cv-profile" if body["technique"] == "cyclic_voltammetry" else "electrolysis-profile"
    return content_id(kind, body)


def source_ids(files: DataFrame, media_type: str) -> DataFrame:
    """(path, source_id, sha256, byte_size) of (path, content), natively."""
    size, sha = F.octet_length("content").cast("long"), F.sha2("content", 256)
    return files.select("path", flat_content_id("source", sha256=sha, byte_size=size, media_type=F.lit(media_type)).alias("source_id"), sha.alias("sha256"), size.alias("byte_size"))


def _identify(kind: str) -> Callable[..., Column]:
    @F.pandas_udf("string")
    def identify(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: content_id(kind, json.loads(body)))

    return identify


def normalise(files: DataFrame, document: str, *, media_type: str = "text/csv", read: Reader = delimited, prefix: str = "", version: str = "0.1.0") -> dict[str, DataFrame]:
    """The tables series, values, graph, findings and refusals of all files
    (path, content) read under one profile.

    A series' identity covers its source, profile, mapping and exact value
    texts. graph has one step for each parse, mapping and assembly, whose
    inputs close to the source; findings say which checks each file passed.
    Files are independent: a file's values meet in one group, no more."""
    profile, own = Profile.from_json(document), profile_id(document)
    kind = "cv" if own.startswith("cv") else "electrolysis"
    parsed = parse(files, profile, read, prefix)
    values = series(parsed).join(source_ids(files, media_type), "path")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value_lex"))), lambda x: x["value_lex"])
    grouped = values.groupBy("path", "source_id", "series", "role", "source_column", "source_unit", "target_unit").agg(ordered.alias("values"))
    body = F.to_json(
        F.struct(
            F.col("source_id").alias("source_artifact_id"), F.lit(own).alias("import_profile_id"), F.lit("1").alias("schema_version"), F.lit("decimal").alias("dtype"),
            F.array(F.size("values")).alias("shape"), "source_column", "role", "source_unit", F.col("target_unit").alias("unit"), "values",
        )
    )
    identified = grouped.withColumn("series_id", _identify(f"{kind}-series")(body)).withColumn("n", F.size("values"))
    per_file = identified.groupBy("path", "source_id").agg(F.max("n").alias("row_count"), F.transform(F.array_sort(F.collect_list(F.struct("series", "series_id"))), lambda x: x["series_id"]).alias("series_ids"))
    table = flat_content_id("csv-table" if not prefix else "dta-table", source_artifact_id=F.col("source_id"), import_profile_id=F.lit(own), parser_version=F.lit(PARSER_VERSION), row_count=F.col("row_count"))
    whole = flat_content_id(f"{kind}-observation", source_artifact_id=F.col("source_id"), import_profile_id=F.lit(own), normalisation_version=F.lit(version), row_count=F.col("row_count"), series=F.array_join("series_ids", ","))
    ids = per_file.withColumn("table_id", table).withColumn("observation_id", whole)
    step = lambda kind, inputs, outputs: F.struct(F.lit(kind).alias("kind"), inputs.alias("inputs"), outputs.alias("outputs"))
    steps = F.concat(
        F.array(step("parse", F.array("source_id"), F.array("table_id"))),
        F.transform("series_ids", lambda s: step("column_mapping", F.array("table_id"), F.array(s))),
        F.array(step("observation_assembly", F.col("series_ids"), F.array("observation_id"))),
    )
    flat = ids.select("path", F.col("observation_id").alias("graph_id"), F.posexplode(steps).alias("ordinal", "s"))
    graph = flat.select("path", "graph_id", F.col("ordinal").cast("long").alias("ordinal"), "s.kind", "s.inputs", "s.outputs")
    open_ = unclosed(graph, ids.select(F.col("observation_id").alias("graph_id"), F.col("source_id").alias("id"))).select("graph_id").distinct().withColumn("open", F.lit(True))
    codes = F.explode(F.array(F.lit("structure.valid"), F.lit("axes.valid"), F.lit("unit.mapping.valid"), F.lit("lineage.closed"))).alias("code")
    roles = identified.groupBy("path").agg(F.collect_set("role").alias("roles"))
    checked = ids.select("path", F.col("observation_id").alias("graph_id"), codes).join(open_, "graph_id", "left").join(roles, "path")
    axes = F.array_contains("roles", "potential") & (F.array_contains("roles", "current") | F.array_contains("roles", "current_density"))
    status = F.when((F.col("code") == "lineage.closed") & F.col("open"), "fail").when((F.col("code") == "axes.valid") & ~axes, "fail").otherwise("pass")
    findings = checked.select("path", F.col("graph_id").alias("subject_id"), "code", status.alias("status"))
    return {"series": identified, "values": values, "graph": graph, "findings": findings, "refusals": refusals(parsed)}


def electrolysis_problems(values: DataFrame, interval: Column | None = None) -> DataFrame:
    """(path, rule, idx): times that don't increase, or steps other than the
    declared interval. ``values`` is the values table of ``normalise``."""
    from galvanite.operators.series import not_increasing, off_interval

    time = values.where("role = 'time'").select("path", "idx", "value")
    out = not_increasing(time, ["path"], ["idx"], "value").select("path", F.lit("time_not_increasing").alias("rule"), "idx")
    if interval is not None:
        out = out.unionByName(off_interval(time, ["path"], ["idx"], "value", interval).select("path", F.lit("sampling_interval_mismatch").alias("rule"), "idx"))
    return out
