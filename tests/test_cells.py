"""Scalar functions over cells."""

import pytest
from pyspark.sql import functions as F

from vigilgrid.functions import cells as C


def many(spark, values, function):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(function(F.col("v"))).collect()]


def test_normalize_header(spark):
    found = many(spark, [" Product  Code ", "", None, "\t"], lambda c: C.normalize_header(c, F.lit(3)))
    assert found == ["product__code", "unnamed_3", "unnamed_3", "unnamed_3"]


def test_normalize_label(spark):
    assert many(spark, ["  Product \t Code ", None], C.normalize_label) == ["product code", ""]


@pytest.mark.parametrize(
    "text, expected",
    [("5", True), ("5.", True), (".5", True), ("-1", False), ("1e3", False), (".", False), ("", False), ("1.2.3", False)],
)
def test_numeric_like(spark, text, expected):
    assert many(spark, [text], C.numeric_like) == [expected]


def test_number_cleaning(spark):
    texts = ["USD 3", "1,234.50 EUR", "-7", "none", "", None]
    assert many(spark, texts, C.clean_number_text) == ["3", "1234.50", "-7", "", "", ""]
    texts = ["USD 3", "1,234.50", "-.5", "1-2", ".", "", None]
    assert many(spark, texts, C.clean_number) == [3.0, 1234.5, -0.5, None, None, None, None]


def test_date_cleaning(spark):
    texts = ["2025-01-31", "01/31/2025", "31-Jan-2025", "20250131", "2025-01-31 10:11:12", "soon", "2025-02-30", ""]
    day = "2025-01-31"
    assert many(spark, texts, C.clean_date_text) == [day] * 5 + ["soon", "2025-02-30", ""]
    shown = many(spark, texts, lambda c: C.clean_date(c).cast("string"))
    assert shown == [day] * 5 + [None, None, None]


def test_string_cleaning(spark):
    assert many(spark, [" a ", "nan", None], C.clean_string) == ["a", "", ""]


def test_cell_bounds(spark):
    df = spark.createDataFrame([(["a", None],)], "cells array<string>")
    found = df.select(*[C.cell(F.col("cells"), F.lit(i)) for i in (0, 1, 2, -1)]).first()
    assert list(found) == ["a", "", "", ""]


def test_headers_that_look_like_data(spark):
    df = spark.createDataFrame([(["a", "1"],), (["a", "b"],), ([],), (["a", "b", "c", "1"],)], "h array<string>")
    assert [r[0] for r in df.select(C.header_looks_like_data(F.col("h"))).collect()] == [True, False, True, False]
