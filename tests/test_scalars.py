"""Literal vectors of the scalar operators."""

import math

import pytest
from pyspark.sql import functions as F

from vettra.functions import fixed, scalars


def value(spark, f, *args):
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    df = spark.createDataFrame([args], ", ".join(f"c{i} {kinds[type(a)]}" for i, a in enumerate(args)))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(args)))).alias("x")).first().x


@pytest.mark.parametrize("text, want", [("Rs. 1,45,000", 145000.0), ("₹12,34,567", 1234567.0), ("5 lakh", 5e5), ("1.2 crore", 1.2e7), ("3 lacs", 3e5), ("no number", None), ("", None), (None, None)])
def test_parse_amount(spark, text, want):
    got = value(spark, scalars.parse_amount, text)
    assert got == want or math.isclose(got, want)


@pytest.mark.parametrize("text", ["15/01/2024", "15-01-2024", "15.01.2024", "15 Jan 2024", "15-Jan-2024", "2024-01-15", "15/01/24"])
def test_parse_date(spark, text):
    assert value(spark, scalars.parse_date, text) == "2024-01-15"


def test_parse_date_pivot_and_garbage(spark):
    assert value(spark, scalars.parse_date, "01/02/69") == "1969-02-01"
    assert value(spark, scalars.parse_date, "garbage") is None and value(spark, scalars.parse_date, "45/13/2024") is None


def test_pan(spark):
    ok = value(spark, scalars.validate_pan, " abcpv1234d ")
    assert ok.valid and ok.normalized == "ABCPV1234D" and ok.holder_type == "Individual"
    assert value(spark, scalars.validate_pan, "ABCCV1234D").holder_type == "Company"
    for bad in ("ABCQV1234D", "ABCPV123D", "", None):
        assert not value(spark, scalars.validate_pan, bad).valid


def test_verhoeff_published_vectors(spark):
    assert value(spark, scalars.verhoeff_valid, "2363") is True
    assert value(spark, scalars.verhoeff_valid, "2364") is False
    assert value(spark, scalars.verhoeff_valid, "x") is None


@pytest.mark.parametrize("text, want", [("XXXXXXXX1234", (True, True, False)), ("**** **** 1234", (True, True, False)), ("1234", (False, False, False)), ("012345678901", (False, False, True)), ("", (False, False, False)), (None, (False, False, False))])
def test_aadhaar(spark, text, want):
    assert tuple(value(spark, scalars.validate_aadhaar, text)) == want


def test_ifsc(spark):
    ok = value(spark, scalars.validate_ifsc, "hdfc0001234")
    assert ok.valid and ok.bank_code == "HDFC"
    assert not value(spark, scalars.validate_ifsc, "HDFC1001234").valid


def test_masks(spark):
    text = "PAN ABMPS1234F acct 123456789012 plot SY-911/2C sum 1234567"
    assert value(spark, scalars.redact_text, text) == "PAN AB*******F acct ********9012 plot SY-*** sum 1234567"
    assert value(spark, scalars.mask_whole, "Asha") == "A***" and value(spark, scalars.mask_whole, "ABMPS1234F") == "AB*******F"


def test_names_and_ids(spark):
    assert value(spark, scalars.norm_name, "Shri. Ravi  Kumar-Rao") == "RAVI KUMAR RAO"
    assert value(spark, scalars.norm_name, "Dr.") is None
    assert value(spark, scalars.norm_id, "ab-12 c") == "AB12C"
    assert value(spark, scalars.safe_name, "a/b c?.pdf") == "b_c_.pdf"


def test_amount_ratios(spark):
    assert value(spark, scalars.pct_diff, 1820000.0, 820000.0) > 0.4
    assert value(spark, scalars.pct_diff, 1820000.0, 1638000.0) < 0.2
    assert value(spark, scalars.pct_diff, 0.4, 0.1) == 0.0
    emi = value(spark, scalars.emi, 1500000.0, 60)
    assert 32000 < emi < 32500
    assert math.isclose(value(spark, scalars.max_principal, emi, 60), 1500000.0, rel_tol=1e-9)
    assert value(spark, scalars.max_principal, -1.0, 60) == 0.0


def test_floor_days(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 23:59:59' AS a, timestamp'2024-01-02 00:00:00' AS b")
    row = df.select(scalars.floor_days(F.col("a"), F.col("b")).alias("x"), scalars.floor_days(F.col("b"), F.col("a")).alias("y")).first()
    assert (row.x, row.y) == (-1, 0)


def test_pdf_date(spark):
    assert str(value(spark, scalars.parse_pdf_date, "D:20240115103000+05'30'")) == "2024-01-15 10:30:00"
    assert value(spark, scalars.parse_pdf_date, "D:20241315103000") is None


def test_edit_distance_and_runs(spark):
    assert value(spark, scalars.edit_within_one, "abc", "abd") and not value(spark, scalars.edit_within_one, "abc", "bad")
    assert value(spark, scalars.digit_runs, "1,234 and 99 and 1234 x 56789") == ["1234", "56789"]


def test_weights():
    assert math.isclose(sum(fixed.WEIGHTS.values()), 1.0)
    assert fixed.CRITICAL_CEILING < fixed.FREEZE_BELOW < fixed.APPROVE_AT
