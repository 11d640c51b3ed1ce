"""Names, keys and small rules over recorded text: native column functions."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Checksum algorithms that a file listing may name.
CHECKSUMS = ("md5", "sha256")
#: What kind of source a member is, by the end of its path; the first that fits counts.
SOURCE_TYPES = (("_XPS_predicted.csv", "predicted_xps"), ("_XPS.csv", "measured_xps"), ("_EDX.csv", "measured_edx"), ("_LSV.csv", "measured_lsv"))
#: The member of fitted parameters, and its kind.
FITTED = ("SECCM_dataset/LSV_fit_parameters.csv", "source_fitted_parameters")
#: The kinds that are measurements.
MEASURED = ("measured_edx", "measured_lsv", "measured_xps")
#: Pairs of origin and mode that a record may carry.
ADMISSIBLE = (("observed", "live"), ("observed", "replay"), ("synthetic", "replay"), ("synthetic", "simulation"))
#: The scope of work instructions and the longest client key.
SCOPE, LONGEST_KEY = "execute_work_item", 255


def checksum_parts(text: Column) -> Column:
    """struct<algorithm, digest, problem> of ``algorithm:digest``. Without a
    colon, or with nothing behind it, there is no algorithm; what stands
    before it must be a known one, and the digest may be blank."""
    said = F.substring(text, F.instr(text, ":") + 1, F.length(text))
    algorithm, digest = F.lower(F.trim(F.substring_index(text, ":", 1))), F.lower(F.trim(said))
    problem = F.when(text.isNull() | (F.instr(text, ":") == 0) | (said == ""), "no_algorithm").when(~algorithm.isin(*CHECKSUMS), "unsupported_algorithm")
    ok = problem.isNull()
    return F.struct(F.when(ok, algorithm).alias("algorithm"), F.when(ok, digest).alias("digest"), problem.alias("problem"))


def unsafe_filename(name: Column) -> Column:
    """Why a listed name can't be a file name here, or null."""
    return (
        F.when(name.isNull() | name.isin("", ".", ".."), "unusable")
        .when(name.contains("/") | name.contains("\\") | name.contains("\0"), "separator")
        .when(F.substring(name, 2, 1) == ":", "drive")
    )


def source_type(path: Column) -> Column:
    """The kind of an archive member; null if no rule knows it, never a default."""
    out = F.when(path == FITTED[0], FITTED[1])
    for end, kind in SOURCE_TYPES:
        out = out.when(path.endswith(end), kind)
    return out


def measured(kind: Column) -> Column:
    return kind.isin(*MEASURED)


def admissible(origin: Column, mode: Column) -> Column:
    """Whether the pair may be recorded: simulation never yields observed data."""
    pairs = [(origin == o) & (mode == m) for o, m in ADMISSIBLE]
    out = pairs[0]
    for p in pairs[1:]:
        out = out | p
    return F.coalesce(out, F.lit(False))


def environment_mismatch(origin: Column, mode: Column, read_origin: Column, read_mode: Column) -> Column:
    """What a campaign declares against what its adapter reads, or null."""
    return F.when((origin == read_origin) & (mode == read_mode), F.lit(None)).otherwise(F.concat(F.lit("declared "), origin, F.lit("+"), mode, F.lit(", read "), read_origin, F.lit("+"), read_mode))


def instruction_key(work_item: Column, version: Column) -> Column:
    """One key for a work item under a command version, whoever delivers it."""
    return F.concat_ws(":", F.lit(SCOPE), work_item.cast("string"), version.cast("string"))


def client_key(raw: Column) -> Column:
    """struct<key, problem>: a client's key without the white space around it."""
    key = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    problem = F.when(key == "", "missing_key").when(F.length(key) > LONGEST_KEY, "oversized_key")
    return F.struct(F.when(problem.isNull(), key).alias("key"), problem.alias("problem"))


def fingerprint(**columns: Column) -> Column:
    """SHA-256 of a flat request's canonical bytes (see ``canonical``)."""
    return F.sha2(F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def interval_in_seconds(value: Column, unit: Column) -> Column:
    """A declared sampling interval in ms or s, exactly; null for other units."""
    return F.when(unit == "ms", value * F.lit("0.001").cast("decimal(4,3)")).when(unit == "s", value * F.lit("1.000").cast("decimal(4,3)"))


def lease_expiry(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def budget_cost(reserved: Column, unit: Column, actual: Column) -> Column:
    """struct<estimate, reserved, incurred, actual, unit>: what an attempt
    cost; without an actual amount, what was reserved."""
    incurred = F.coalesce(actual, reserved)
    return F.struct(reserved.alias("estimate"), reserved.alias("reserved"), incurred.alias("incurred"), incurred.alias("actual"), unit.alias("unit"))


def redistribution(declared: Column, licence: Column, doi: Column, *, decided_licence: str, decided_doi: str, decision: str) -> Column:
    """The recorded decision where both the licence and the DOI are those it
    was made for; else what was declared stays."""
    return F.when((licence == decided_licence) & (doi == decided_doi), decision).otherwise(declared)


def escaped(text: Column) -> Column:
    """Text for an HTML page."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def sniffed_delimiter(sample: int = 4096):
    """A column function: the delimiter that the first ``sample`` characters
    of a text suggest, a comma if none does. Python's sniffer, in batches."""

    def guess(text: str | None) -> str:
        try:
            return csv.Sniffer().sniff((text or "")[:sample], delimiters=",;\t|").delimiter
        except csv.Error:
            return ","

    @F.pandas_udf("string")
    def sniff(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(guess)

    return sniff
