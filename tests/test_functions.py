from datetime import UTC, datetime
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galvanite.functions import canonical, lifecycle, units


def test_trailing_zeros_are_part_of_an_identity():
    assert canonical.content_id("x", {"v": Decimal("1.10")}) != canonical.content_id("x", {"v": Decimal("1.1")})


def test_key_order_is_not():
    assert canonical.content_id("x", {"a": 1, "b": None}) == canonical.content_id("x", {"b": None, "a": 1})


def test_text_is_normalised():
    assert canonical.canonical_bytes("é") == canonical.canonical_bytes("é")


@pytest.mark.parametrize("bad", [1.5, b"x", {1: 2}, Decimal("NaN"), datetime(2024, 1, 1), object()])
def test_ambiguous_values_are_refused(bad):
    with pytest.raises((TypeError, ValueError)):
        canonical.canonical_bytes(bad)


def test_times_are_in_utc():
    assert canonical.canonical_bytes(datetime(2024, 1, 1, tzinfo=UTC)) == b'"2024-01-01T00:00:00+00:00"'


@given(st.sets(st.text()))
def test_sets_have_one_form(values):
    assert canonical.canonical_bytes(values) == canonical.canonical_bytes(set(sorted(values, reverse=True)))


def test_native_identity_equals_python(spark):
    rows = [(1, "a"), (2, None), (3, 'q"u\\o'), (4, "é\n\t")]
    frame = spark.createDataFrame(rows, "n long, t string")
    found = frame.select("n", canonical.flat_content_id("r", n=F.col("n"), t=F.col("t")).alias("i")).collect()
    assert {r.n: r.i for r in found} == {n: canonical.content_id("r", {"n": n, "t": t}) for n, t in rows}


def test_nested_identity(spark):
    frame = spark.createDataFrame([('{"b": [1, {"z": null, "a": "x"}]}',), (None,)], "t string")
    found = [r.i for r in frame.select(canonical.nested_content_id("n")("t").alias("i")).collect()]
    assert found == [canonical.content_id("n", {"b": [1, {"a": "x", "z": None}]}), None]


@pytest.mark.parametrize(("text", "unit", "target", "wanted"), [("10.0", "mA", "A", "0.0100"), ("-2.40000E-001", "V", "V", "-0.240000"), ("0.00000E+000", "V", "V", "0.00000"), ("60", "min", "s", "3600")])
def test_scales_add(text, unit, target, wanted):
    assert units.times(text, units.FACTOR[unit, target]) == wanted


def test_native_scale(spark):
    frame = spark.createDataFrame([("10.0",), ("-2.40000E-001",), ("5",), ("1.5e3",)], "t string")
    assert [r[0] for r in frame.select(units.scale(F.col("t"))).collect()] == [1, 6, 0, 0]


def test_unknown_pairs_do_not_convert(spark):
    frame = spark.createDataFrame([("mA", "A", Decimal("2")), ("mA", "V", Decimal("2"))], "source_unit string, target_unit string, value decimal(18,2)")
    found = {r.target_unit: (r.converted, r.error) for r in units.convert(frame, units.factor_table(spark)).collect()}
    assert found == {"A": (Decimal("0.002"), None), "V": (None, "unsupported_unit_mapping")}


def test_backoff_doubles_up_to_its_limit(spark):
    frame = spark.range(1, 12).select(lifecycle.backoff_seconds(F.col("id")).alias("w"))
    assert [r.w for r in frame.collect()] == [2, 4, 8, 16, 32, 64, 128, 256, 300, 300, 300]


def test_checksum_outranks_reference(spark):
    true = F.lit(True)
    verdict = lifecycle.object_verdict(true, F.lit("committed"), F.lit("a"), F.lit("b"), true, F.lit(None).cast("string"))
    assert spark.range(1).select(verdict.alias("v")).first().v.verdict == "quarantined"
