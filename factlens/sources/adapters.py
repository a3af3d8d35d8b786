"""Tables of the test star schema as the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import canonical_decimal
from .tables import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _decimal_text(c: Column) -> Column:
    return canonical_decimal(c.cast("decimal(20,4)"))


def records_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records an order: its total and its priority."""
    orders = _read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "pending").otherwise("warning")
    facts = F.inline(
        F.array(
            F.struct(F.lit(0).alias("k"), F.lit("order_total").alias("metric"), F.lit("USD").alias("unit"), _decimal_text(F.col("o_totalprice")).alias("value_raw")),
            F.struct(F.lit(1).alias("k"), F.lit("priority_rank").alias("metric"), F.lit("rank").alias("unit"), F.substring("o_orderpriority", 1, 1).alias("value_raw")),
        )
    )
    base = orders.select(
        F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 97 + 1).alias("document_id"),
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("entity"),
        F.date_format("o_orderdate", "yyyy-MM").alias("reporting_period"), status.alias("validation_status"), facts,
    )
    return base.select(
        (F.col("key") * 2 + F.col("k")).alias("record_id"), "document_id", "entity", "metric", "unit", "reporting_period",
        "value_raw", F.col("value_raw").alias("normalized_value"), F.lit("table").alias("extraction_method"), "validation_status",
    )


def records_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_records(_read(spark, sf_dir, "events"))


def events_as_records(events: DataFrame) -> DataFrame:
    """One record an event, of a table or a stream; confidence is k / 100 of its properties."""
    raw = _decimal_text(F.col("value"))
    return events.select(
        F.col("event_id").alias("record_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("entity"),
        F.lit("event_value").alias("metric"), F.lit("pt").alias("unit"), F.date_format("ts", "yyyy-MM-dd").alias("reporting_period"),
        raw.alias("value_raw"), raw.alias("normalized_value"), F.lit("table").alias("extraction_method"), F.lit("pass").alias("validation_status"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
    )


def dirty_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals with seeded faults, by the last digit of the key."""
    orders = _read(spark, sf_dir, "orders")
    raw, digit = _decimal_text(F.col("o_totalprice")), F.col("o_orderkey") % 10
    value = F.when(digit == 0, "1O5").when(digit == 1, "1,20,000").when(digit == 2, F.concat(F.lit("-"), raw)).when(digit == 6, "10000001").otherwise(raw)
    period = F.when(digit == 4, "31/02/2025").when(digit == 5, "2099-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return orders.select(
        (F.col("o_orderkey") * 2).alias("record_id"), (F.col("o_orderkey") % 97 + 1).alias("document_id"),
        F.when(digit != 3, F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))).alias("entity"),
        F.lit("order_total").alias("metric"), value.alias("value_raw"), F.lit("USD").alias("unit"), period.alias("reporting_period"),
        F.lit("table").alias("extraction_method"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("review_required"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a validation status from the labels table."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "review_required").otherwise("pass").alias("validation_status"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("filename"), "lang", "source", "n_chars",
        F.when(F.col("validation_status").isNull(), "uploaded").when(F.col("validation_status") == "error", "failed").otherwise("processed").alias("status"), "validation_status",
    )


def pages(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Each document as its one page."""
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    docs = docs.where(F.col("lang") == lang) if lang else docs
    return docs.select(
        F.col("doc_id").alias("page_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("page").alias("content_type"),
        F.lit(None).cast("string").alias("section_reference"), F.col("text").alias("extracted_text"), F.lit("extracted").alias("extraction_status"),
    )


def vector_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as units."""
    kind = F.element_at(F.array(F.lit("record"), F.lit("page"), F.lit("validation")), (F.col("label") % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("unit_id"), (F.col("vec_id") % 50).alias("document_id"), kind.alias("unit_type"), F.col("label"), "embedding", F.lit("embedded").alias("embedding_status")
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as search queries: all their words."""
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", '"', " ").alias("text"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, nation, region."""
    c, n, r = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("entity"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )
