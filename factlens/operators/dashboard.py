"""Counts and statistics over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import ELIGIBLE_STATUSES, EXTRACTION_STATUSES, FLAGGED_STATUSES, REVIEW_STATUSES


def status_counts(df: DataFrame, column: str = "validation_status") -> DataFrame:
    return df.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))


def documents(docs: DataFrame) -> DataFrame:
    s = F.col("status")
    return docs.agg(F.count("*").alias("total"), *[F.count_if(s == v).alias(v) for v in ("processed", "failed", "processing", "uploaded")])


def records(rows: DataFrame, column: str = "validation_status") -> DataFrame:
    s = F.col(column)
    return rows.agg(F.count("*").alias("total"), F.count_if(s.isin(*ELIGIBLE_STATUSES)).alias("validated"), F.count_if(s == "pending").alias("pending"), F.count_if(s.isin(*FLAGGED_STATUSES)).alias("flagged"))


def validation(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.agg(F.count("*").alias("total"), *[F.count_if(s == v).alias(n) for v, n in (("pass", "passed"), ("warning", "warnings"), ("error", "errors"), ("review_required", "review_required"))])


def index_stats(units: DataFrame) -> DataFrame:
    """One row: units, by type, documents, embedded, errors, coverage (0 for no units) and, where the units have these columns, how many
    models embedded them and the last update (models() lists them)."""
    kind = lambda k: F.count_if(F.col("unit_type") == k)
    embedded = F.count_if(F.col("embedding_status") == "embedded")
    return units.agg(
        F.count("*").alias("units"), kind("page").alias("page_units"), kind("record").alias("record_units"), kind("validation").alias("validation_units"),
        F.countDistinct("document_id").alias("documents"), embedded.alias("embedded"), F.count_if(F.col("embedding_status") == "failed").alias("errors"),
        F.coalesce(F.try_divide(embedded, F.count("*")), F.lit(0.0)).alias("coverage"),
        *([F.countDistinct("embedding_model").alias("models")] if "embedding_model" in units.columns else []),
        *([F.max("updated_at").alias("last_update")] if "updated_at" in units.columns else []),
    )


def distinct_sketches(rows: DataFrame, by: str, columns: list[str], precision: int = 14) -> DataFrame:
    """(by, rows, a sketch for each column): distinct counts that can be merged, kept for each bucket of a stored table. The relative error of an estimate
    is about 1.04 / sqrt(2 ** precision), 0.8 % at 14, however many buckets are merged."""
    each = [F.hll_sketch_agg(F.col(c), precision).alias(c) for c in columns]
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *each)


def refreshed(sketches: DataFrame, changed: DataFrame, touched: DataFrame, by: str) -> DataFrame:
    """Sketches after a replacement: those of touched buckets are the ones made of their new rows, others stay and their rows are not read. A touched
    bucket without rows has none."""
    return sketches.join(touched.select(by).distinct(), by, "left_anti").unionByName(changed)


def distinct_totals(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """One row: all rows, and about how many different values each column has in all buckets."""
    return sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns])


def models(units: DataFrame) -> DataFrame:
    """(embedding_model, units) in order of name."""
    return units.where("embedding_model is not null").groupBy("embedding_model").agg(F.count("*").alias("units")).orderBy("embedding_model")


def recent_activity(audit: DataFrame, n: int = 8) -> DataFrame:
    """The latest n audit rows."""
    return audit.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(n)


def recent(docs: DataFrame, rows: DataFrame, order: list, n: int = 8) -> DataFrame:
    """The latest n documents with their record count and whether they need review."""
    latest = docs.orderBy(*order).limit(n)
    counted = rows.join(F.broadcast(latest.select("document_id")), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("record_count"))
    review = F.coalesce(F.col("validation_status").isin(*REVIEW_STATUSES), F.lit(False))
    return latest.join(counted, "document_id", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0))).withColumn("requires_review", review)


def extraction_stats(pages: DataFrame) -> DataFrame:
    """Units by document and extraction status, 0 where there are none."""
    return pages.groupBy("document_id").agg(*[F.count_if(F.col("extraction_status") == s).alias(s) for s in EXTRACTION_STATUSES])


def document_counts(docs: DataFrame, pages: DataFrame, rows: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(document_id, pages, records, flagged, pending[, units])."""
    s = F.col("validation_status")
    parts = [
        pages.groupBy("document_id").agg(F.count("*").alias("pages")),
        rows.groupBy("document_id").agg(F.count("*").alias("records"), F.count_if(s.isin(*FLAGGED_STATUSES)).alias("flagged"), F.count_if(s == "pending").alias("pending")),
    ]
    if units is not None:
        parts.append(units.groupBy("document_id").agg(F.count("*").alias("units")))
    out = docs.select("document_id")
    for p in parts:
        out = out.join(p, "document_id", "left")
    return out.na.fill(0)
