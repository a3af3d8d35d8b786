"""Retrieval units: pages, records and validation results in one table, and what is embedded of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.scalars import blank_to_null, canonical_decimal
from ..schemas import UNIT_TYPES

COLUMNS = (
    "unit_id", "document_id", "page_id", "record_id", "validation_id", "unit_type", "title", "content", "source_reference", "entity", "metric",
    "unit", "reporting_period", "extraction_method", "validation_status", "ocr_confidence",
)


def _fill(df: DataFrame) -> DataFrame:
    kinds = {"document_id": "long", "page_id": "long", "record_id": "long", "validation_id": "long", "ocr_confidence": "double"}
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kinds.get(c, "string")))
    return df.select(*COLUMNS)


def page_units(pages: DataFrame, documents: DataFrame | None) -> DataFrame:
    """Pages as units; without documents they have their file name."""
    named = pages if documents is None else pages.join(documents.select("document_id", "filename"), "document_id", "left")
    label = F.coalesce(blank_to_null(F.col("section_reference")), F.concat(F.lit("page "), F.col("page_number").cast("string")))
    confidence = F.col("ocr.confidence").cast("double") if "ocr" in pages.columns else F.lit(None).cast("double")
    return _fill(
        named.select(
            F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("unit_id"), "document_id", "page_id", F.lit("page").alias("unit_type"),
            F.concat(F.coalesce("filename", F.concat(F.lit("document "), F.col("document_id").cast("string"))), F.lit(" — "), label).alias("title"),
            F.col("extracted_text").alias("content"), label.alias("source_reference"),
            F.when(F.col("extraction_status") == "ocr_extracted", "ocr").otherwise("native_text").alias("extraction_method"), confidence.alias("ocr_confidence"),
        )
    )


def record_units(records: DataFrame) -> DataFrame:
    number = canonical_decimal(F.col("metric_value")) if "metric_value" in records.columns else F.lit(None).cast("string")
    content = F.coalesce(blank_to_null(F.col("normalized_value")), number, blank_to_null(F.col("value_raw")), F.lit(""))
    return _fill(
        records.withColumns(
            {"unit_id": F.concat(F.lit("record-"), F.col("record_id").cast("string")), "unit_type": F.lit("record"), "title": F.concat_ws(" — ", "entity", "metric"), "content": content}
        ).drop("ocr_confidence")
    )


def validation_units(results: DataFrame) -> DataFrame:
    out = results.withColumn("__id", F.col("validation_id") if "validation_id" in results.columns else F.xxhash64("record_id", "rule_code", "message"))
    return _fill(
        out.select(
            F.concat(F.lit("validation-"), F.col("__id").cast("string")).alias("unit_id"), "document_id", "record_id", F.col("__id").alias("validation_id"), F.lit("validation").alias("unit_type"),
            F.concat_ws(" — ", "rule_code", "status").alias("title"), F.col("message").alias("content"), F.col("status").alias("validation_status"),
        )
    )


def union(pages: DataFrame, records: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """All units of all documents as one set-based job."""
    return page_units(pages, documents).unionByName(record_units(records)).unionByName(validation_units(results))


def reindex(pages: DataFrame, records: DataFrame, results: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units and their counts by type."""
    units = union(pages, records, results, documents)
    return units, units.groupBy("unit_type").agg(F.count("*").alias("units"), F.countDistinct("document_id").alias("documents"))


def observed(units: DataFrame) -> tuple[DataFrame, Observation]:
    """The units, and what the pass that writes them observes: how many there are, of each type, and of about how many documents. `get` of the
    observation has the figures once an action has run."""
    seen = Observation()
    each = [F.count_if(F.col("unit_type") == kind).alias(kind) for kind in UNIT_TYPES]
    return units.observe(seen, F.count(F.lit(1)).alias("units"), *each, F.approx_count_distinct("document_id", 0.02).alias("documents")), seen


def write_index(pages: DataFrame, records: DataFrame, results: DataFrame, documents: DataFrame, path: str) -> dict[str, int]:
    """Rebuild the stored units from all sources in one job and return the counts that it observed."""
    units, seen = observed(union(pages, records, results, documents))
    units.write.mode("overwrite").parquet(path)
    return seen.get


def embedding_inputs(units: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Adds input_text: the parts that exist, one line for records and validations, cut where the model has a bound."""
    line = lambda c: F.regexp_replace(c, r"\s*\n\s*", " ")
    record = F.concat_ws(" | ", "title", "content", "unit", "reporting_period", "source_reference")
    page = F.concat_ws(" | ", "title", "content")
    text = F.when(F.col("unit_type") == "page", page).otherwise(line(record))
    return units.withColumn("input_text", F.substring(text, 1, max_chars) if max_chars else text)
