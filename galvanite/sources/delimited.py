"""Instrument files read through explicit import profiles.

Nothing is guessed: a profile names the encoding, delimiter, header row,
decimal sign, missing tokens and every column's role and units. A file that
departs from it is refused with the first problem, as a row. Files are read
whole, one by one, in the tasks that scan them."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.functions.units import FACTOR

#: The order in which series are read.
ROLE_RANK = {"potential": 0, "current": 1, "current_density": 1, "time": 2, "cycle": 3}
_NUMBER = {"point": re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), "comma": re.compile(r"[+-]?\d+(?:,\d+)?(?:[eE][+-]?\d+)?")}
_FOREIGN_SIGN = {"point": ",", "comma": "."}

PARSED = "path string, series int, role string, source_column string, source_unit string, target_unit string, idx int, source_lex string, value_lex string, error_code string, error_row int, error_column string"


@dataclass(frozen=True)
class Mapping:
    source_column: str
    role: str
    source_unit: str | None = None
    target_unit: str | None = None


@dataclass(frozen=True)
class Profile:
    columns: tuple[Mapping, ...]
    encoding: str = "utf-8"
    delimiter: str = ","
    decimal_convention: str = "point"
    header_row: int = 1
    missing_value_tokens: tuple[str, ...] = field(default=("",))

    @classmethod
    def from_json(cls, text: str) -> Profile:
        raw = json.loads(text)
        columns = tuple(Mapping(c["source_column"], c["role"], c.get("source_unit"), c.get("target_unit")) for c in raw["columns"])
        return cls(columns, raw["encoding"], raw["delimiter"], raw["decimal_convention"], raw["header_row"], tuple(raw["missing_value_tokens"]))

    def scientific(self) -> list[Mapping]:
        return sorted((c for c in self.columns if c.role != "ignored"), key=lambda c: ROLE_RANK[c.role])


#: Units that a role may have in an electrolysis profile.
ROLE_UNITS = {"time": ("ms", "s"), "current": ("mA", "A"), "current_density": ("mA/cm^2", "A/m^2"), "potential": ("mV", "V"), "ignored": ()}
#: Bases of a current density.
AREA_BASES = ("geometric_area", "electrochemically_active_area", "contact_or_wetted_area")


def profile_problems(document: str) -> list[str]:
    """What an import profile (JSON text) lacks before any file is read under
    it, in a fixed order; an empty list for a complete one. Electrolysis
    profiles also need a time axis, units of their roles, and a current basis
    and area that fit the kind of current."""
    raw = json.loads(document)
    columns, metadata = raw.get("columns") or [], raw.get("metadata") or {}
    roles = [c.get("role") for c in columns]
    names, tokens = [c.get("source_column") for c in columns], raw.get("missing_value_tokens") or []
    electrolysis = raw.get("technique") == "galvanostatic_electrolysis"
    said = lambda field: metadata.get(field) or {}
    basis, area = said("current_basis"), said("electrode_area")
    total = basis.get("value") == "total_current" and area.get("state") == "not_applicable"
    density = basis.get("state") == "known" and basis.get("value") in AREA_BASES and area.get("state") == "known"
    results = raw.get("auxiliary_results") or []
    analysed = said("chemical_analysis").get("state") == "known"
    rules = {
        "no_columns": not columns,
        "unknown_role": any(r not in (*ROLE_RANK, "ignored") for r in roles),
        "bad_delimiter": len(raw.get("delimiter") or "") != 1 or raw.get("delimiter") in ("\r", "\n", '"'),
        "bad_encoding": raw.get("encoding") not in ("utf-8", "utf-8-sig"),
        "comma_is_ambiguous": raw.get("decimal_convention") == "comma" and raw.get("delimiter") == ",",
        "bad_header_row": not isinstance(raw.get("header_row"), int) or raw["header_row"] < 1,
        "repeated_column": len(names) != len(set(names)),
        "repeated_token": len(tokens) != len(set(tokens)),
        "one_potential": roles.count("potential") != 1,
        "one_current": roles.count("current") + roles.count("current_density") != 1,
        "one_time": roles.count("time") != 1 if electrolysis else roles.count("time") > 1,
        "one_cycle": roles.count("cycle") > (0 if electrolysis else 1),
        "unit_of_other_role": electrolysis and any(u and u not in ROLE_UNITS.get(c.get("role"), ()) for c in columns for u in (c.get("source_unit"), c.get("target_unit"))),
        "current_context": electrolysis and (("current" in roles and not total) or ("current_density" in roles and not density)),
        "auxiliary_context": electrolysis and bool(results) != analysed,
        "repeated_result": len({r.get("result_id") for r in results}) != len(results),
    }
    return [rule for rule, broken in rules.items() if broken]


class Refused(Exception):
    """The first problem of a file: code, row and column."""

    def __init__(self, code: str, row: int | None = None, column: str | None = None):
        super().__init__(code)
        self.code, self.row, self.column = code, row, column


Rows = list[tuple[int, Sequence[str]]]


def decoded(data: bytes, encoding: str) -> str:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        raise Refused("encoding_error") from None


def delimited(data: bytes, profile: Profile) -> tuple[Sequence[str], Rows]:
    """Header cells and numbered body rows; no trimming, no row is dropped."""
    reader = csv.reader(io.StringIO(decoded(data, profile.encoding), newline=""), delimiter=profile.delimiter, strict=True)
    try:
        rows = list(reader)
    except csv.Error:
        raise Refused("malformed_csv", reader.line_num or None) from None
    if len(rows) < profile.header_row:
        raise Refused("header_missing")
    return rows[profile.header_row - 1], list(enumerate(rows[profile.header_row :], profile.header_row + 1))


def check_structure(header: Sequence[str], rows: Rows, expected: set[str] | None) -> None:
    if not header or "" in header:
        raise Refused("blank_header")
    names = set(header)
    if len(names) < len(header):
        raise Refused("duplicate_header")
    if expected is not None:
        for code, absent in (("missing_column", expected - names), ("unexpected_column", names - expected)):
            if absent:
                raise Refused(code, column=min(absent))
    for number, row in rows:
        if len(row) != len(header):
            raise Refused("row_length_mismatch" if row else "blank_row", number)


def number(cell: str, profile: Profile) -> Decimal:
    """A cell's exact decimal, or Refused with the kind of its defect."""
    if cell in profile.missing_value_tokens:
        raise Refused("missing_scientific_value")
    if _FOREIGN_SIGN[profile.decimal_convention] in cell:
        raise Refused("locale_mismatch")
    try:
        value = Decimal(cell.replace(",", "."))
    except InvalidOperation:
        raise Refused("non_numeric_cell") from None
    if not value.is_finite():
        raise Refused("non_finite_value")
    if not _NUMBER[profile.decimal_convention].fullmatch(cell):
        raise Refused("non_numeric_cell")
    return value


def mapped(header: Sequence[str], rows: Rows, profile: Profile) -> Iterator[tuple[Mapping, list[tuple[Decimal, Decimal]]]]:
    """Each scientific column with (source, converted) values, in role order."""
    check_structure(header, rows, {c.source_column for c in profile.columns})
    for column in profile.scientific():
        factor = FACTOR.get((column.source_unit or "", column.target_unit or ""))
        if factor is None:
            raise Refused("unsupported_unit_mapping", column=column.source_column)
        at, values = header.index(column.source_column), []
        for line, row in rows:
            try:
                value = number(row[at], profile)
            except Refused as problem:
                raise Refused(problem.code, line, column.source_column) from None
            values.append((value, value * factor))
        yield column, values


Reader = Callable[[bytes, Profile], tuple[Sequence[str], Rows]]


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of every matching file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def parse(sources: DataFrame, profile: Profile, read: Reader = delimited, prefix: str = "") -> DataFrame:
    """One row for each value of each series of ``sources`` (path, content),
    or one with error_code for a refused file. Values are exact text; see
    ``series`` and ``refusals``. A null content is refused as an empty file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = list(mapped(*read(content or b"", profile), profile))
                except Refused as problem:
                    code = problem.code if problem.code.startswith(prefix) else prefix + problem.code
                    yield pd.DataFrame([(path, *[None] * 8, code, problem.row, problem.column)], columns=names)
                    continue
                for k, (c, values) in enumerate(found):
                    yield pd.DataFrame([(path, k, c.role, c.source_column, c.source_unit, c.target_unit, i, format(s, "f"), format(v, "f"), None, None, None) for i, (s, v) in enumerate(values)], columns=names)

    return sources.select("path", "content").mapInPandas(run, PARSED)


def series(parsed: DataFrame) -> DataFrame:
    """Values of accepted files, with a decimal beside the exact text."""
    return parsed.where("error_code is null").drop("error_code", "error_row", "error_column").withColumn("value", F.col("value_lex").try_cast("decimal(38,18)"))


def refusals(parsed: DataFrame) -> DataFrame:
    return parsed.where("error_code is not null").select("path", "error_code", "error_row", "error_column")


def inspect(sources: DataFrame, profile: Profile) -> DataFrame:
    """(path, headers, row_count, error_code, error_row): structure only,
    names are given no meaning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    header, rows = delimited(content or b"", profile)
                    check_structure(header, rows, None)
                    out.append((path, list(header), len(rows), None, None))
                except Refused as problem:
                    out.append((path, None, None, problem.code, problem.row))
            yield pd.DataFrame(out, columns=["path", "headers", "row_count", "error_code", "error_row"])

    return sources.select("path", "content").mapInPandas(run, "path string, headers array<string>, row_count int, error_code string, error_row int")
