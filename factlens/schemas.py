"""Statuses and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Statuses.
PASS, VALID, WARNING, ERROR, FAILED = "pass", "valid", "warning", "error", "failed"
REVIEW_REQUIRED, PENDING = "review_required", "pending"
ELIGIBLE_STATUSES = (PASS, VALID)
REVIEW_STATUSES = (WARNING, ERROR, REVIEW_REQUIRED)
FLAGGED_STATUSES = (WARNING, ERROR, REVIEW_REQUIRED, FAILED)
EXTRACTION_STATUSES = ("extracted", "ocr_extracted", "no_text", "ocr_required", "failed")
DOCUMENT_STATUSES = ("uploaded", "queued", "processing", "processed", "failed")
REVIEW_DECISIONS = ("open", "in_review", "resolved", "rejected")
UNIT_TYPES = ("record", "page", "validation")

DECIMAL = T.DecimalType(38, 10)

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value_raw", T.StringType()),
        T.StructField("normalized_value", T.StringType()),
        T.StructField("metric_value", T.DecimalType(20, 4)),
        T.StructField("unit", T.StringType()),
        T.StructField("reporting_period", T.StringType()),
        T.StructField("source_reference", T.StringType()),
        T.StructField("confidence", T.DecimalType(5, 4)),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("validation_status", T.StringType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("section_reference", T.StringType()),
        T.StructField("extracted_text", T.StringType()),
        T.StructField("extraction_status", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("validation_status", T.StringType()),
    ]
)

UNITS = T.StructType(
    [
        T.StructField("unit_id", T.StringType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("validation_id", T.LongType()),
        T.StructField("unit_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source_reference", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("reporting_period", T.StringType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("validation_status", T.StringType()),
        T.StructField("ocr_confidence", T.DoubleType()),
    ]
)

TABLES = {"records": RECORDS, "pages": PAGES, "documents": DOCUMENTS, "units": UNITS}
