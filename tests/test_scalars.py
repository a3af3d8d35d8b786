from datetime import date

import pytest
from pyspark.sql import functions as F

from factlens.functions import scalars as S


def values(spark, fn, inputs):
    rows = [(i, x) for i, x in enumerate(inputs)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, x string").orderBy("i").select(fn(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (S.normalize_number, {"1,200": "1200", "1,20,000": "120000", "12.50": "12.5", "1200.0": "1200", "1O5": None, "12.3.4": None, "l23": None, "": None, None: None, "-45.5": "-45.5", " 12 ": "12"}),
        (S.normalize_period, {"2023": "2023", "2025-26": "2025-26", "not-a-date": None, "30/06/2025": "2025-06-30", "1800": None}),
        (S.normalize_value, {"  A  B   C ": "A B C", "": None, "a b": "a b", "é": "é"}),
        (S.record_type, {"demo_coal": "coal", "Coal": "coal", "": "unknown", None: "unknown", "demo_": "unknown"}),
        (S.slug, {"Production 2024!": "production_2024", "--": ""}),
        (lambda c: S.one_line(c, 5), {"a  b": "a b", "abcdefgh": "abcd…"}),
    ],
)
def test_text_functions(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_numbers_and_dates(spark):
    assert [None if x is None else float(x) for x in values(spark, S.parse_number, ["1200", "1,20,000", "1O5", "NaN", None])] == [1200, 120000, None, None, None]
    assert [None if x is None else float(x) for x in values(spark, S.parse_numeric, ["1,200", "1200 tonnes", "abc", "  42 "])] == [None, None, None, 42]
    day = date(2025, 6, 30)
    assert values(spark, S.parse_date, ["2025-06-30", "30/06/2025", "30-06-2025", "30.06.2025", "2025/06/30", "31/02/2025", "x"]) == [day] * 5 + [None, None]


def test_period_sequence(spark):
    rows = [(0, "2024-11", "2025-02"), (1, "2020", "2022"), (2, "2024", "2024-05"), (3, "2025", "2020"), (4, None, "2020"), (5, "1000", "2000")]
    out = spark.createDataFrame(rows, "i int, a string, b string").orderBy("i").select(F.coalesce(S.period_sequence(F.col("a"), F.col("b"), 100, 120), F.array().cast("array<string>"))).collect()
    assert [r[0] for r in out] == [["2024-11", "2024-12", "2025-01", "2025-02"], ["2020", "2021", "2022"], [], [], [], []]


def test_ocr_summary(spark):
    boxes = spark.createDataFrame([([("a", 0.9), ("b", 0.5)],), ([],)], "b array<struct<text:string,confidence:double>>")
    a, b = [r[0] for r in boxes.select(S.ocr_summary(F.col("b"))).collect()]
    assert (a.confidence, a.low, a.review_required, a.text) == (0.7, 1, True, "a\nb")
    assert (b.confidence, b.review_required) == (None, True)


def test_cells_go_to_python_in_one_column(spark):
    from factlens.operators import records as R

    rows = [[" Café  x ", "1 0", None, "2025"], ["Mine", " ", "t", "2025"], [" ", "5", "", "31/12/2024"], ["Pit", "7"]]
    sections = spark.createDataFrame([(1, 2, [(1, ["Entity", "Quantity", "UOM", "Date"], rows)])], "document_id long, section_index int, tables array<struct<table_index: int, headers: array<string>, rows: array<array<string>>>>")
    found = R.from_tables(sections)
    got = sorted((r.entity, r.value_raw, r.unit, r.reporting_period) for r in found.collect())
    assert got == [("Café x", "1 0", None, "2025"), ("Pit", "7", None, None), ("UNKNOWN_ENTITY", "5", None, "2024-12-31")]
    python = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in line]
    assert len(python) == 1 and python[0].split("], [")[0].count("_nfc") == 1
