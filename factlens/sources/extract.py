"""Extraction jobs: files to units, with pluggable extractors, and the shaping of what they return."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import blank_to_null, normalize_page_text

UNIT = "document_id long, page_number int, content_type string, section_reference string, extracted_text string, extraction_status string, error string"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Stored files as rows (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def run(files_df: DataFrame, extractors: dict[str, Callable[[bytes], Iterator[dict]]]) -> DataFrame:
    """Units of files (document_id, path, content). The extractor is found by the extension, with or without a dot, in any case; a
    file that fails gives one failed unit with the error's text and harms no other."""
    table = {k.lower().lstrip("."): v for k, v in extractors.items()}
    names = [c.split()[0] for c in UNIT.split(", ")]

    def job(batches):
        for pdf in batches:
            rows = []
            for document_id, path, content in zip(pdf.document_id, pdf.path, pdf.content):
                extension = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                try:
                    if extension not in table:
                        raise ValueError(f"no extractor for {extension or 'a file without extension'}")
                    for i, unit in enumerate(table[extension](bytes(content)), 1):
                        rows.append({"document_id": document_id, "page_number": i, "content_type": "page", "extraction_status": None, **unit})
                except Exception as e:  # noqa: BLE001  the file's own fault becomes a row
                    rows.append({"document_id": document_id, "page_number": 1, "content_type": "page", "extraction_status": "failed", "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    out = files_df.select("document_id", "path", "content").mapInPandas(job, UNIT)
    return unit_status(out.withColumn("extracted_text", normalize_page_text(F.col("extracted_text"))))


def unit_status(units: DataFrame, min_chars: int = 8) -> DataFrame:
    """Units with too little text need recognition; what has failed stays failed."""
    enough = F.length(F.trim(F.coalesce("extracted_text", F.lit("")))) >= min_chars
    return units.withColumn("extraction_status", F.when(F.col("extraction_status") == "failed", "failed").when(enough, "extracted").otherwise(F.coalesce("extraction_status", F.lit("ocr_required"))))


def document_status(units: DataFrame) -> DataFrame:
    """(document_id, extraction_status): of all units if they agree, else mixed; documents are never reclassified by one page."""
    return units.groupBy("document_id").agg(F.min("extraction_status").alias("a"), F.max("extraction_status").alias("b")).select(
        "document_id", F.when((F.col("a") == F.col("b")) & F.col("a").isin("no_text", "extracted", "ocr_required"), F.col("a")).otherwise("mixed").alias("extraction_status")
    )


def sheet_units(grids: DataFrame, max_cells: int | None = None) -> DataFrame:
    """Sheets (…, grid) with tab-separated text, row and column counts; where a bound is given, sheets over it are error units that say so."""
    text = F.array_join(F.transform("grid", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")
    columns = F.coalesce(F.array_max(F.transform("grid", lambda r: F.size(r))), F.lit(0))
    out = grids.withColumn("row_count", F.size("grid")).withColumn("column_count", columns)
    big = F.col("row_count").cast("long") * F.col("column_count") > max_cells if max_cells else F.lit(False)
    return out.withColumn("extracted_text", F.when(~big, text)).withColumn("extraction_status", F.when(big, "failed").when(F.trim(text) == "", "no_text").otherwise("extracted")).withColumn("error", F.when(big, F.format_string("more than %d cells", F.lit(max_cells or 0))))


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks (document_id, ord, kind, style, text, rows) as sections in order: paragraphs that follow each other are one, each table
    is its own with its first row as headers; headings read `[Heading n]`."""
    order = W.partitionBy("document_id").orderBy("ord")
    table = (F.col("kind") == "table").cast("int")
    # A new section begins at each table and behind it.
    starts = F.when((table == 1) | (F.lag(table, 1, 1).over(order) == 1), 1).otherwise(0)
    level = F.regexp_extract(F.coalesce("style", F.lit("")), r"(?i)^heading\s*(\d+)", 1)
    line = F.when(level != "", F.concat(F.lit("[Heading "), level, F.lit("] "), "text")).otherwise(F.col("text"))
    numbered = blocks.withColumn("section_index", F.sum(starts).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("line", line)
    parts = F.array_sort(F.collect_list(F.when(blank_to_null(F.col("line")).isNotNull(), F.struct("ord", "line"))))
    out = numbered.groupBy("document_id", "section_index").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("extracted_text"), F.max("kind").alias("kind"), F.first("rows", ignorenulls=True).alias("rows"))
    is_table = F.col("kind") == "table"
    return out.withColumn("headers", F.when(is_table, F.try_element_at("rows", F.lit(1)))).withColumn("rows", F.when(is_table, F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))))


def content(pages: DataFrame, documents: DataFrame, document_id: int) -> DataFrame:
    """A processed document's units in source order."""
    done = documents.where((F.col("document_id") == document_id) & (F.col("status") == "processed")).select("document_id")
    return pages.where(F.col("document_id") == document_id).join(done, "document_id", "left_semi").orderBy("page_number")
