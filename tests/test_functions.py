"""Literal cases of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from limpid.functions import dates, numbers, text

D = datetime.date


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_date(spark):
    cases = {"2024-1-2": D(2024, 1, 2), "1/2/2024": D(2024, 2, 1), "2024/1/2": D(2024, 1, 2), "31/02/2024": None,
             "1/2/24": None, "24-1-2": None, "2024-01-02 00:00:00": None, "20240102": None, "x": None, "  ": None,
             " 2024-01-02\t": D(2024, 1, 2), "1600-01-01": None, "2300-01-01": None, "2262-04-11": D(2262, 4, 11)}
    assert apply(spark, dates.parse_date, cases) == list(cases.values())


def test_tolerant_formats(spark):
    assert apply(spark, lambda c: dates.parse_date(c, dates.DAY_FIRST), ["2024-02-01 10:00:00", "3-4-2024", "03/04/2024"]) == [
        D(2024, 2, 1), D(2024, 4, 3), D(2024, 4, 3)]
    assert apply(spark, lambda c: dates.parse_date(c, dates.MONTH_FIRST), ["2024-02-01", "03/14/2024"]) == [
        D(2024, 2, 1), D(2024, 3, 14)]


def test_money(spark):
    cases = {"$50.886,00": 50886.0, "$54.702": 54702.0, "1234.56": 123456.0, "(12)": 12.0, "-5": -5.0, "1e5": 15.0,
             "1,234,567": None, "5-": None, "--3": None, "nan": None, " ": None}
    assert apply(spark, numbers.money, cases) == list(cases.values())


def test_auto_decimal(spark):
    cases = {"1.234,56": 1234.56, "1,234.56": 1234.56, "12,5": 12.5, "1.234": 1.234, "a": None, "1,2,3": None, "-": None}
    assert apply(spark, numbers.auto_decimal, cases) == list(cases.values())


def test_plain_and_relaxed(spark):
    cases = {"1e5": 100000.0, " 12 ": 12.0, ".5": 0.5, "1d": None, "12f": None, "0x1F": None, "1_000": None, "nan": None,
             "inf": None, "+3.": 3.0}
    assert apply(spark, numbers.plain_number, cases) == list(cases.values())
    assert apply(spark, numbers.relaxed_number, ["1.234,5", "1 000", "12%"]) == [1234.5, 1000.0, None]


def test_percent(spark):
    assert apply(spark, numbers.percent, ["12,5%", "12", "%"]) == [0.125, None, None]


def test_formats(spark):
    row = spark.range(1).select(
        numbers.spanish_number(F.lit(1234567.891)).alias("a"), numbers.spanish_number(F.lit(12345), 0).alias("b"),
        text.percent_text(F.lit(1), F.lit(8)).alias("c"), text.percent_text(F.lit(1), F.lit(0)).alias("d")).first()
    assert tuple(row) == ("1.234.567,89", "12.345", "12.50%", "0.00%")


def test_currency_prefix(spark):
    assert apply(spark, numbers.currency_prefix, ["clp", "USD", "xyz", None]) == ["$", "USD ", "XYZ ", None]


def test_trim_is_unicode_aware(spark):
    assert apply(spark, text.blank_to_null, ["\xa0a b　\n", "\t  ", ""]) == ["a b", None, None]


@pytest.mark.parametrize("raw, slug, semantic", [
    (" Monto  Total ", "monto_total", "monto_total"), ("Categoría", "categor_a", "categoría"), ("###", "", "col"),
    ("unit-price (%)", "unit_price", "unit-price_%"), ("A__b", "a_b", "a__b")])
def test_header_text(spark, raw, slug, semantic):
    from limpid.sources.headers import semantic_name, slug_name
    assert apply(spark, text.slug, [raw]) == [slug] == [slug_name(raw)]
    assert apply(spark, text.semantic_slug, [raw]) == [semantic] == [semantic_name(raw)]


def test_unique_names():
    from limpid.sources.headers import header_names, unique_names
    assert unique_names(["a", "a", "a"]) == ["a", "a_2", "a_3"]
    assert unique_names(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    assert header_names(["Fecha ", " Cliente", "###", "Monto  ", ""]) == ["fecha", "cliente", "col_1", "monto", "col_2"]


def test_prettify(spark):
    assert apply(spark, text.prettify, ["unit_price--x", "_a"]) == ["Unit price x", "A"]
