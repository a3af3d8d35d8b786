"""Scalar functions on columns. All parsing gives NULL for what cannot be read, never an error."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

DECIMAL = "decimal(38,10)"
# Accepted date formats, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d")
DATE_SHAPES = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$", r"^\d{4}/\d{1,2}/\d{1,2}$")
ELLIPSIS = "…"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def parse_number(c: Column) -> Column:
    """Thousands separators and blanks are ignored; `1O5` is no number."""
    return F.regexp_replace(F.trim(c), "[, ]", "").try_cast(DECIMAL)


def parse_numeric(c: Column) -> Column:
    """Strict: no separators."""
    return F.trim(c).try_cast(DECIMAL)


def parse_date(c: Column) -> Column:
    text = F.trim(c)
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_date(text, f)) for f, shape in zip(DATE_FORMATS, DATE_SHAPES)])


def canonical_decimal(c: Column) -> Column:
    """Decimal text without trailing zeros and without exponent."""
    text = c.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def normalize_number(c: Column) -> Column:
    return canonical_decimal(parse_number(c))


def normalize_date(c: Column) -> Column:
    return F.date_format(parse_date(c), "yyyy-MM-dd")


def normalize_period(c: Column) -> Column:
    """ISO date, year 1900 to 2200, or a label like 2025-26 or 2025/26; else NULL."""
    text = F.trim(c)
    year = F.when(text.rlike(r"^\d{4}$") & text.try_cast("int").between(1900, 2200), text)
    return F.coalesce(normalize_date(c), year, F.when(text.rlike(r"^\d{4}[-/]\d{2}$"), text))


def normalize_value(c: Column) -> Column:
    """Unicode blanks collapsed, ends trimmed, empty to NULL. Python is used where a text is not ASCII, for NFC."""
    collapsed = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(collapsed != "", F.when(collapsed.rlike(r"[^\x00-\x7F]"), _nfc(collapsed)).otherwise(collapsed))


def normalize_values(c: Column) -> Column:
    """normalize_value of each text of an array. One column goes to Python for all of them, and only those arrays that hold a text that is not ASCII;
    `c` should be a column, which is used more than once."""
    collapsed = F.transform(c, lambda v: F.nullif(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")), F.lit("")))
    foreign = F.exists(c, lambda v: F.coalesce(v.rlike(r"[^\x00-\x7F]"), F.lit(False)))
    return F.coalesce(_nfc_all(F.when(foreign, collapsed)), collapsed)


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(ArrayType(StringType()))
def _nfc_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFC", t) for t in ts])


def normalize_page_text(c: Column) -> Column:
    """NULs out, CRLF to LF, blanks collapsed, line ends stripped, one empty line at most."""
    out = F.regexp_replace(F.regexp_replace(c, "\x00", ""), "\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t\f\u000b ]+", " "), " *\n", "\n")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def record_type(metric: Column) -> Column:
    """Lower-case metric without a leading demo_, 64 characters at most, `unknown` if nothing is left."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.lower(F.trim(metric)), "^demo_", ""), 1, 64), F.lit("")), F.lit("unknown"))


def one_line(c: Column, n: int) -> Column:
    """Blanks flattened; longer texts are cut and end in an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit(ELLIPSIS))).otherwise(flat)


def defang(c: Column) -> Column:
    """Delimiter runs that could close a quoted block lose their force."""
    return F.regexp_replace(F.regexp_replace(c, "<{2,}", "<"), ">{2,}", ">")


def period_kind(c: Column) -> Column:
    """year, month or NULL, for calendar sequences."""
    return F.when(c.rlike(r"^\d{4}$"), "year").when(c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), "month")


def period_sequence(first: Column, last: Column, max_years: int | None = None, max_months: int | None = None) -> Column:
    """All years or months from first to last; empty where they are of different kinds or out of order, NULL where they are further
    apart than asked for."""
    nothing = F.array().cast("array<string>")
    both_years = (period_kind(first) == "year") & (period_kind(last) == "year")
    both_months = (period_kind(first) == "month") & (period_kind(last) == "month")
    y0, y1 = first.try_cast("int"), last.try_cast("int")
    m0, m1 = F.try_to_date(F.concat(first, F.lit("-01")), "yyyy-MM-dd"), F.try_to_date(F.concat(last, F.lit("-01")), "yyyy-MM-dd")
    far_years = (y1 - y0 > max_years) if max_years is not None else F.lit(False)
    far_months = (F.months_between(m1, m0) > max_months) if max_months is not None else F.lit(False)
    years = F.when(y1 < y0, nothing).otherwise(F.transform(F.sequence(F.least(y0, y1), y1), lambda y: y.cast("string")))
    months = F.when(m1 < m0, nothing).otherwise(F.transform(F.sequence(F.least(m0, m1), m1, F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM")))
    return F.when(both_years, F.when(~far_years, years)).when(both_months, F.when(~far_months, months)).otherwise(nothing)


def label_case(c: Column) -> Column:
    return F.initcap(c)


def ocr_summary(boxes: Column, threshold: float = 0.70, keep: int = 200) -> Column:
    """struct<confidence, low, review_required, text, boxes> of array<struct<text, confidence, ...>>."""
    n = F.size(boxes)
    total = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + b["confidence"].cast("double"))
    mean = F.when(n > 0, F.round(total / n, 4))
    low = F.size(F.filter(boxes, lambda b: b["confidence"] < threshold))
    return F.struct(
        mean.alias("confidence"), low.alias("low"), ((low > 0) | F.coalesce(mean < threshold, F.lit(True))).alias("review_required"),
        F.array_join(F.transform(boxes, lambda b: b["text"]), "\n").alias("text"), F.slice(boxes, 1, keep).alias("boxes"),
    )


def meta(json: Column, path: str) -> Column:
    """Access into a JSON text by a dotted path."""
    return F.get_json_object(json, f"$.{path}")
