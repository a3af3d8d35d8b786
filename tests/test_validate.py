from datetime import date

import pytest

from factlens.operators import validate as V

SCHEMA = "record_id long, document_id long, entity string, metric string, value_raw string, unit string, reporting_period string, confidence double, review_required boolean"
BASE = {"record_id": 1, "document_id": 1, "entity": "M", "metric": "coal", "value_raw": "1200", "unit": "t", "reporting_period": "2025-06-30", "confidence": None, "review_required": False}
AS_OF = date(2026, 1, 1)


def frame(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c)[x.split()[0]] for x in SCHEMA.split(", ")) for c in changes], SCHEMA)


def codes(spark, *changes, **config):
    return sorted((r.rule_code, r.status) for r in V.run(frame(spark, *changes), V.Config(as_of=AS_OF, **config)).collect())


@pytest.mark.parametrize(
    ("change", "config", "expected"),
    [
        ({}, {}, []),
        ({"entity": None}, {}, [("REQUIRED_FIELD_MISSING", "error")]),
        ({"entity": "  "}, {}, [("REQUIRED_FIELD_MISSING", "error")]),
        ({"value_raw": "1O5"}, {}, [("NUMERIC_FORMAT", "error")]),
        ({"value_raw": "-50"}, {"ranges": {}}, [("NUMERIC_NEGATIVE", "error")]),
        ({"value_raw": "-50"}, {"ranges": {}, "numeric": {"value_raw": V.Numeric(allow_negative=True)}}, []),
        ({"value_raw": "1200.5"}, {"numeric": {"value_raw": V.Numeric(integer_only=True)}}, [("NUMERIC_INTEGER_EXPECTED", "warning")]),
        ({}, {"ranges": {"value_raw": V.Range(0, 1200)}}, []),
        ({}, {"ranges": {"value_raw": V.Range(0, 1200, inclusive=False)}}, [("RANGE_OUT_OF_BOUNDS", "error")]),
        ({"value_raw": "150"}, {"ranges": {"value_raw": V.Range(0, 100, status="warning")}}, [("RANGE_OUT_OF_BOUNDS", "warning")]),
        ({"reporting_period": "31/02/2025"}, {}, [("DATE_INVALID", "warning")]),
        ({"reporting_period": "2099-01-01"}, {}, [("DATE_FUTURE", "warning")]),
        ({"reporting_period": "2099-01-01"}, {"dates": {"reporting_period": True}}, []),
        ({"reporting_period": "2025-26"}, {"accept_periods": True}, []),
        ({"confidence": 0.95}, {}, []),
        ({"confidence": 0.42}, {}, [("OCR_LOW_CONFIDENCE", "review_required")]),
        ({"review_required": True}, {}, [("OCR_REVIEW_FLAGGED", "review_required")]),
    ],
)
def test_row_rules(spark, change, config, expected):
    assert codes(spark, change, **config) == expected


def test_group_rules(spark):
    same = V.run(frame(spark, {}, {"record_id": 2, "document_id": 2}), V.Config(as_of=AS_OF)).collect()
    assert [(r.rule_code, r.record_id, r.expected_value) for r in same] == [("DUPLICATE_DETECTED", 2, "1")]
    found = codes(spark, {}, {"record_id": 2, "document_id": 2, "value_raw": "1350"})
    assert found == [("CROSS_DOCUMENT_CONFLICT", "review_required"), ("DUPLICATE_DETECTED", "warning")]


def test_own_rule(spark):
    own = V.Rule("row", lambda config: [V.outcome("MINE", "warning", "info", "seen")])
    assert [r.rule_code for r in V.run(frame(spark, {}), V.Config(as_of=AS_OF), rules=(own,)).collect()] == ["MINE"]


def test_rollups_and_decisions(spark):
    rows = frame(spark, {}, {"record_id": 2, "value_raw": "x", "entity": "N"}, {"record_id": 3, "document_id": 2, "entity": "O"}).selectExpr("*", "'pending' as validation_status")
    out = V.run(rows, V.Config(as_of=AS_OF))
    assert {r.record_id: r.validation_status for r in V.rollup_records(rows, out).collect()} == {1: "pending", 2: "failed", 3: "pending"}
    assert {r.record_id: r.validation_status for r in V.rollup_records(rows, out, promote_clean=True).collect()} == {1: "valid", 2: "failed", 3: "valid"}
    assert {r.document_id: r.validation_status for r in V.rollup_documents(out).collect()} == {1: "error"}
    results = spark.createDataFrame([(7, "x"), (8, "y")], "validation_id long, original_value string")
    decisions = spark.createDataFrame([(7, "in_review", "a", 1), (7, "resolved", "b", 2), (8, "nonsense", "c", 3)], "validation_id long, review_status string, review_notes string, reviewed_at long")
    assert {r.validation_id: (r.review_status, r.original_value) for r in V.apply_decisions(results, decisions).collect()} == {7: ("resolved", "x"), 8: ("open", "y")}


def test_ocr_page(spark):
    pages = spark.createDataFrame([(5, 1, 2, "page", "1O5", "ocr_extracted", (0.42, True)), (6, 1, 3, "page", "ok", "extracted", (None, None))], "page_id long, document_id long, page_number int, content_type string, extracted_text string, extraction_status string, ocr struct<confidence:double,review_required:boolean>")
    out = V.run(frame(spark, {}), V.Config(as_of=AS_OF), pages).collect()
    assert [(r.rule_code, r.original_value, r.record_id) for r in out] == [("OCR_LOW_CONFIDENCE", "1O5", None)]


def test_a_key_with_a_third_of_all_rows_spreads_without_adaptive_plans(spark):
    from pyspark.sql import functions as F

    from factlens.operators.skew import join_key

    rows = spark.range(30_000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k"), F.lit("x").alias("extra"))
    per_key = rows.groupBy("k").agg(F.min("record_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        met = join_key(rows, per_key, ["k"], least=1000)
        assert met.columns == ["record_id", "k", "extra", "first"]
        sizes = [r["c"] for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * 30_000 / 16
        want = rows.join(per_key.drop("n"), "k").select(met.columns)
        assert met.exceptAll(want).isEmpty() and want.exceptAll(met).isEmpty()
    finally:
        for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
