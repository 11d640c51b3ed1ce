import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from galvanite.plans import normalise
from galvanite.sources import archives, delimited, dta, packages
from galvanite.sources.delimited import Mapping, Profile

PROFILE = Profile((Mapping("n", "ignored"), Mapping("e", "potential", "mV", "V"), Mapping("i", "current", "A", "A")), missing_value_tokens=("", "NA"))


def parsed(spark, data, profile=PROFILE):
    frame = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    return delimited.parse(frame, profile)


def problem(spark, data, profile=PROFILE):
    rows = delimited.refusals(parsed(spark, data, profile)).collect()
    return (rows[0].error_code, rows[0].error_row) if rows else None


def test_values_keep_their_text(spark):
    rows = delimited.series(parsed(spark, b"n,e,i\n0,-240,1.50e-3\n1,0,2\n")).orderBy("series", "idx").collect()
    assert [(r.role, r.value_lex) for r in rows] == [("potential", "-0.240"), ("potential", "0.000"), ("current", "0.00150"), ("current", "2")]


@pytest.mark.parametrize(
    ("data", "code", "row"),
    [
        (b"\xff", "encoding_error", None),
        (b'n,e,i\n1,"2', "malformed_csv", 2),
        (b"", "header_missing", None),
        (b"n,,i\n", "blank_header", None),
        (b"n,e,e\n", "duplicate_header", None),
        (b"n,e\n", "missing_column", None),
        (b"n,e,i,x\n", "unexpected_column", None),
        (b"n,e,i\n\n1,2,3\n", "blank_row", 2),
        (b"n,e,i\n1,2\n", "row_length_mismatch", 2),
        (b"n,e,i\n1,NA,3\n", "missing_scientific_value", 2),
        (b'n,e,i\n1,"2,5",3\n', "locale_mismatch", 2),
        (b"n,e,i\n1,x,3\n", "non_numeric_cell", 2),
        (b"n,e,i\n1,NaN,3\n", "non_finite_value", 2),
        (b"n,e,i\n1,1_0,3\n", "non_numeric_cell", 2),
        (b"n,e,i\n1,2,x\n2,x,3\n", "non_numeric_cell", 3),  # potential is read before current
        (b"n,e,i\n1,2,3\n", None, None),
    ],
)
def test_first_problem(spark, data, code, row):
    assert problem(spark, data) == ((code, row) if code else None)


def test_unsupported_units_are_refused(spark):
    profile = Profile((Mapping("e", "potential", "V", "mV"),))
    assert problem(spark, b"e\n1\n", profile) == ("unsupported_unit_mapping", None)


def test_comma_decimals(spark):
    profile = Profile((Mapping("e", "potential", "V", "V"),), delimiter=";", decimal_convention="comma")
    assert delimited.series(parsed(spark, b"e\n1,50\n", profile)).first().value_lex == "1.50"


def test_inspection(spark):
    frame = spark.createDataFrame([("a", bytearray(b"x,y\n1,2\n")), ("b", None)], "path string, content binary")
    found = {r.path: (r.row_count, r.error_code) for r in delimited.inspect(frame, PROFILE).collect()}
    assert found == {"a": (1, None), "b": (None, "header_missing")}


DTA = "EXPLAIN\nTAG\tCV\nTITLE\tx\nFRAMEWORKVERSION\tQUANT\t7.07\tv\nCURVE\tTABLE\t{n}\n" + "\t" + "\t".join(dta.HEADER) + "\n\t" + "\t".join(dta.UNITS) + "\n"
LINE = "\t0\t0.0\t-2.40000E-001\t1.20000E-002\t0\t0\t0\t9\t..\t0\t25.0\n"
DTA_PROFILE = Profile(tuple(Mapping(c, *dta.MAPPED.get(c, ("ignored", None, None))) for c in dta.HEADER), delimiter="\t", header_row=6)


@pytest.mark.parametrize(
    ("text", "code"),
    [
        (DTA.format(n=1) + LINE, None),
        ("X\n", "dta_unsupported_structure"),
        (DTA.format(n=1).replace("TAG\tCV", "TAG\tEIS") + LINE, "dta_unsupported_technique"),
        (DTA.format(n=1).replace("7.07", "7.10") + LINE, "dta_unsupported_framework_version"),
        (DTA.format(n=1).replace("7.07", "7,07") + LINE, "dta_locale_mismatch"),
        (DTA.format(n="x") + LINE, "dta_invalid_row_count"),
        (DTA.format(n=2) + LINE, "dta_table_truncated"),
        (DTA.format(n=1) + LINE + LINE, "dta_unsupported_trailing_content"),
        (DTA.format(n=1).replace("\tVf\t", "\tVx\t") + LINE, "dta_unsupported_table_schema"),
        (DTA.format(n=1) + LINE.replace("1.20000E-002", "?"), "dta_non_numeric_cell"),
        (DTA.format(n=1) + "CURVE2\tTABLE\t1\n" + LINE, "dta_mixed_technique_blocks"),
    ],
)
def test_dta(spark, text, code):
    frame = spark.createDataFrame([("f", bytearray(text.encode()))], "path string, content binary")
    rows = dta.parse_dta(frame, DTA_PROFILE).collect()
    assert rows[0].error_code == code
    if code is None:
        assert {r.role: r.value_lex for r in rows} == {"potential": "-0.240000", "current": "0.0120000", "time": "0.0", "cycle": "0"}
        assert dta.object_types(frame).first().object_types == ["EXPLAIN", "FRAMEWORKVERSION", "TAG", "TITLE"]


DOCUMENT = json.dumps({"schema_version": "1", "technique": "cyclic_voltammetry", "environment_id": "t", "encoding": "utf-8", "delimiter": ",", "decimal_convention": "point", "header_row": 1, "missing_value_tokens": ["NA", ""], "columns": [{"source_column": "e", "role": "potential", "source_unit": "V", "target_unit": "V"}, {"source_column": "i", "role": "current", "source_unit": "A", "target_unit": "A"}], "metadata": {}})


def test_profile_identity_ignores_column_order():
    other = json.loads(DOCUMENT)
    other["columns"].reverse()
    other["missing_value_tokens"].reverse()
    assert normalise.profile_id(DOCUMENT) == normalise.profile_id(json.dumps(other))
    other["columns"][0]["target_unit"] = "mA"
    assert normalise.profile_id(DOCUMENT) != normalise.profile_id(json.dumps(other))


def test_normalise_closes_its_lineage(spark):
    frame = spark.createDataFrame([("a", bytearray(b"e,i\n1.0,2\n")), ("b", bytearray(b"e,i\n1.00,2\n")), ("c", bytearray(b"e\n"))], "path string, content binary")
    out = normalise.normalise(frame, DOCUMENT)
    ids = {(r.path, r.role): r.series_id for r in out["series"].collect()}
    assert len(set(ids.values())) == 4
    assert {r.status for r in out["findings"].collect()} == {"pass"}
    assert [(r.path, r.error_code) for r in out["refusals"].collect()] == [("c", "missing_column")]
    assert out["graph"].count() == 8


def test_electrolysis_times(spark):
    from decimal import Decimal

    values = spark.createDataFrame([("f", "time", i, Decimal(v)) for i, v in enumerate((0, 60, 60, 120))], "path string, role string, idx int, value decimal(38,18)")
    found = {(r.rule, r.idx) for r in normalise.electrolysis_problems(values, F.lit(60)).collect()}
    assert found == {("time_not_increasing", 2), ("sampling_interval_mismatch", 2)}


def archive(contents):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, data in contents:
            box.writestr(name, data)
    return bytearray(out.getvalue())


def test_archive_index_and_points(spark):
    name = "SECCM_dataset/Au-Ir-Rh_Au-rich_SECCM_area_12_x=1.5_y=-2.0_LSV.csv"
    text = ",".join(archives.SWEEP_HEADER) + "\r\n0.1,-0.5,0\r\n0.2,x,0\r\n"
    frame = spark.createDataFrame([("z", archive([(name, text), (archives.FIT_MEMBER, ""), ("other.txt", "")])), ("bad", bytearray(b"no"))], "path string, content binary")
    found = archives.members(frame)
    index = archives.sweep_index(found)
    assert [(r.library_id, r.area_id, r.member) for r in index.collect()] == [("Au-rich", "12", name)]
    assert [r.member for r in archives.unmatched(found).collect()] == ["other.txt"]
    assert [(r.row_no, r.current is None) for r in archives.sweep_points(found).orderBy("row_no").collect()] == [(0, False), (1, True)]
    asked = spark.createDataFrame([("Au-rich", "12"), ("Ir-rich", "1")], "library_id string, area_id string")
    assert {r.library_id: r.failure_code for r in archives.look_up(asked, index).collect()} == {"Au-rich": None, "Ir-rich": "source_location_unavailable"}
    assert [(r.path, r.problem) for r in archives.unsafe(found).collect()] == [("bad", "unreadable")]


def test_packages_are_deterministic_and_tampering_shows(spark, tmp_path):
    good = packages.package({"a.json": b"{}", "b.txt": b"x"})
    assert good == packages.package({"b.txt": b"x", "a.json": b"{}"})
    box = zipfile.ZipFile(io.BytesIO(good))
    changed = archive([(n, b"y" if n == "b.txt" else box.read(n)) for n in box.namelist()])
    short = archive([(n, box.read(n)) for n in box.namelist() if n != "a.json"])
    extra = archive([*((n, box.read(n)) for n in box.namelist()), ("new", b"")])
    climbing = archive([("../x", b"")])
    frame = spark.createDataFrame([("good", bytearray(good)), ("changed", changed), ("short", short), ("extra", extra), ("climbing", climbing)], "path string, content binary")
    assert {(r.path, r.member, r.problem) for r in packages.verify(frame).collect()} == {("changed", "b.txt", "checksum_mismatch"), ("short", "a.json", "missing"), ("extra", "new", "unexpected"), ("climbing", None, "unsafe_name")}
    digest = packages.put_verified(tmp_path, b"data")
    assert digest == hashlib.sha256(b"data").hexdigest() == packages.put_verified(tmp_path, b"data")
    lines = packages.json_lines(spark.createDataFrame([(2, "b"), (1, None)], "n long, t string"), "n")
    assert lines == b'{"n":1}\n{"n":2,"t":"b"}\n'
