"""Scalar functions over sheet cells: labels, numbers, dates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, collapse_space, strip

NUMERIC_PATTERN = rf"^({DIGIT}+\.?{DIGIT}*|\.{DIGIT}+)$"

# Date layouts tried in order; the first that fits the whole text wins.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MMM-yyyy",
    "yyyyMMdd",
)


def blank(value: Column) -> Column:
    return F.coalesce(strip(value), F.lit("")) == ""


def normalize_header(value: Column, index: Column) -> Column:
    text = F.lower(strip(F.coalesce(value, F.lit(""))))
    unnamed = F.concat(F.lit("unnamed_"), index.cast("string"))
    return F.when(text == "", unnamed).otherwise(F.regexp_replace(text, " ", "_"))


def normalize_headers(cells: Column) -> Column:
    return F.transform(cells, lambda value, i: normalize_header(value, i))


def normalize_label(value: Column) -> Column:
    return F.lower(collapse_space(strip(F.coalesce(value, F.lit("")))))


def numeric_like(value: Column) -> Column:
    return F.coalesce(strip(value), F.lit("")).rlike(NUMERIC_PATTERN)


def header_looks_like_data(headers: Column) -> Column:
    numeric = F.size(F.filter(headers, numeric_like))
    return (F.size(headers) == 0) | (
        numeric >= F.greatest(F.lit(1), F.floor(F.size(headers) / F.lit(2)).cast("int"))
    )


def clean_number_text(value: Column) -> Column:
    text = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), ",", "")
    return F.regexp_extract(text, rf"-?{DIGIT}+(?:\.{DIGIT}+)?", 0)


def clean_number(value: Column) -> Column:
    """Number from the digits, dots and minus signs of a text; null where they form none."""
    return F.regexp_replace(value, r"[^\p{Nd}.\-]", "").try_cast("double")


def _shape(layout: str) -> str:
    """Pattern of the texts a date layout can fit."""
    digits = {"yyyy": "[0-9]{4}", "MMM": "[A-Za-z]{3}"}
    plain = layout.replace("'", "")
    return "^" + re.sub("yyyy|MMM|MM|dd|HH|mm|ss", lambda m: digits.get(m.group(), "[0-9]{2}"), plain) + "$"


def parse_date(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date in the first layout that fits; a cheap pattern keeps the parser off all other texts."""
    text = strip(value)
    tried = [F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats]
    return F.coalesce(*tried).cast("date")


def clean_date(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date or null."""
    return parse_date(value, formats)


def clean_date_text(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """ISO date text; text in no known layout stays as it is."""
    parsed = F.date_format(parse_date(value, formats), "yyyy-MM-dd")
    return F.coalesce(parsed, strip(F.coalesce(value, F.lit(""))))


def clean_string(value: Column) -> Column:
    text = strip(F.coalesce(value, F.lit("")))
    return F.when(text == "nan", "").otherwise(text)


def cell(cells: Column, index: Column) -> Column:
    """Cell at a zero-based index; null, negative or out-of-range indexes give an empty cell."""
    usable = index.isNotNull() & (index >= 0) & (index < F.size(cells))
    return F.coalesce(F.when(usable, F.get(cells, index)), F.lit(""))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)
