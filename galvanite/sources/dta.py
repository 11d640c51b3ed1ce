"""One pinned variant of a tab-separated potentiostat export.

The file is a list of tagged lines, then one curve table with a row of names,
a row of units and a declared number of rows. Anything else is refused."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.sources.delimited import Profile, Refused, Rows, decoded, parse

#: The table of the supported variant, names and units.
HEADER = ("Pt", "T", "Vf", "Im", "Vu", "Sig", "Ach", "IERange", "Over", "Cycle", "Temp")
UNITS = ("#", "s", "V vs. Ref.", "A", "V", "V", "V", "#", "bits", "#", "deg C")
FRAMEWORK = Decimal("7.07")
#: The only mapping of this variant that has a meaning.
MAPPED = {"T": ("time", "s", "s"), "Vf": ("potential", "V vs. Ref.", "V"), "Im": ("current", "A", "A"), "Cycle": ("cycle", "#", "1")}


def _demand(fine: bool, code: str, line: int | None = None) -> None:
    if not fine:
        raise Refused(f"dta_{code}", line)


def _framework(cells: Sequence[str], profile: Profile, line: int) -> None:
    _demand(len(cells) >= 3 and cells[1] == "QUANT", "unsupported_structure", line)
    text, point = cells[2], profile.decimal_convention == "point"
    _demand(("," if point else ".") not in text, "locale_mismatch", line)
    plain = text if point else text.replace(",", ".")
    _demand(re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", plain) is not None and Decimal(plain) == FRAMEWORK, "unsupported_framework_version", line)


def _suits(profile: Profile, header_line: int) -> bool:
    own = {c.source_column: (c.role, c.source_unit, c.target_unit) for c in profile.columns if c.role != "ignored"}
    return profile.delimiter == "\t" and profile.header_row == header_line and own == MAPPED and {c.source_column for c in profile.columns} == set(HEADER)


def table(data: bytes, profile: Profile) -> tuple[Sequence[str], Rows]:
    """Header and numbered rows of the curve table, or Refused."""
    lines = [x.split("\t") for x in decoded(data, profile.encoding).splitlines()]
    where = lambda test: [(i, c) for i, c in enumerate(lines, 1) if test(c)]
    _demand(bool(lines) and lines[0] == ["EXPLAIN"], "unsupported_structure", 1)

    tags = where(lambda c: c[0] == "TAG")
    _demand(bool(tags), "unsupported_structure")
    _demand(len(tags) == 1, "mixed_technique_blocks", tags[-1][0])
    _demand(tags[0][0] == 2 and len(tags[0][1]) >= 2, "unsupported_structure", 2)
    _demand(tags[0][1][1] == "CV", "unsupported_technique", 2)

    versions = where(lambda c: c[0] == "FRAMEWORKVERSION")
    _demand(len(versions) == 1, "unsupported_structure")
    _framework(versions[0][1], profile, versions[0][0])

    tables = where(lambda c: c[1:2] == ["TABLE"])
    _demand(len(tables) < 2, "mixed_technique_blocks", tables[1][0] if len(tables) > 1 else None)
    _demand(bool(tables), "unsupported_structure")
    at, declared = tables[0]
    _demand(len(declared) == 3 and declared[0] == "CURVE", "unsupported_technique", at)
    _demand(re.fullmatch("[0-9]+", declared[2]) is not None and int(declared[2]) > 0, "invalid_row_count", at)
    count = int(declared[2])

    _demand(len(lines) >= at + 2, "table_truncated", at)
    heads = {at + 1: ("", *HEADER), at + 2: ("", *UNITS)}  # line -> its cells
    for width in (1, None):  # both lines are indented, then both are as they must be
        for line, cells in heads.items():
            _demand(tuple(lines[line - 1][:width]) == cells[:width], "unsupported_table_schema", line)
    _demand(_suits(profile, at + 1), "profile_mismatch", at + 1)

    body = lines[at + 2 :]
    _demand(len(body) >= count, "table_truncated", max(at, len(lines)))
    _demand(len(body) == count, "unsupported_trailing_content", at + 3 + count)
    _demand(all(c[0] == "" for c in body), "unsupported_table_schema", at + 3)
    return lines[at][1:], [(i, c[1:]) for i, c in enumerate(body, at + 3)]


def parse_dta(sources: DataFrame, profile: Profile) -> DataFrame:
    """As ``delimited.parse``; every code starts with dta_."""
    return parse(sources, profile, table, "dta_")


def object_types(sources: DataFrame) -> DataFrame:
    """(path, object_types): sorted distinct first cells before the curve
    table, kept though nothing reads them. Built-in functions only."""
    lines = sources.select("path", F.posexplode(F.split(F.decode("content", "utf-8"), r"\r\n|\n|\r")).alias("at", "line"))
    cells = lines.withColumn("cells", F.split("line", "\t"))
    start = cells.where(F.get("cells", F.lit(1)) == "TABLE").groupBy("path").agg(F.min("at").alias("start"))
    before = cells.join(start, "path", "left").where(F.col("start").isNull() | (F.col("at") < F.col("start")))
    return before.groupBy("path").agg(F.array_sort(F.collect_set(F.when(F.col("cells")[0] != "", F.col("cells")[0]))).alias("object_types"))
