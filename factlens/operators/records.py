"""Records from cell grids, tables, recognised images and free text. Raw values stay as they are; normalised ones are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import blank_to_null, normalize_number, normalize_period, normalize_values, parse_number, record_type, slug

# Header names by which a column is recognised, the first that is present wins.
ALIASES = {
    "entity": ("mine", "entity", "mine name", "entity_name"),
    "value": ("value", "quantity", "production", "amount"),
    "unit": ("unit", "units", "uom"),
    "period": ("period", "reporting period", "date", "year", "month"),
    "metric": ("metric", "field", "parameter"),
}
COLUMNS = ("document_id", "page_id", "record_type", "entity", "metric", "value_raw", "normalized_value", "metric_value", "unit", "reporting_period", "source_reference", "extraction_method", "confidence", "review_required")


def _column(headers: Column, names: tuple[str, ...]) -> Column:
    """Place of the first alias among the headers, from 1; NULL if there is none."""
    return F.coalesce(*[F.nullif(F.array_position(headers, n), F.lit(0)) for n in names])


def _finish(df: DataFrame) -> DataFrame:
    for c, kind in (("page_id", "long"), ("confidence", "double"), ("review_required", "boolean"), ("unit", "string"), ("reporting_period", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.withColumns(
        {"normalized_value": normalize_number(F.col("value_raw")), "metric_value": parse_number(F.col("value_raw")).try_cast("decimal(20,4)"), "record_type": record_type(F.col("metric"))}
    ).select(*COLUMNS)


def from_rows(df: DataFrame, headers: Column, rows: Column, reference: Column, method: str, fallback_metric: Column, first_row: int, aliases: dict = ALIASES) -> DataFrame:
    """One record a row of cells that has a value. `rows` are those below the headers; `first_row` numbers the first of them."""
    named = df.withColumn("__h", F.transform(headers, lambda h: F.lower(F.trim(h)))).withColumn("__reference", reference).withColumn("__fallback", fallback_metric)
    for field, names in aliases.items():
        named = named.withColumn(f"__{field}", _column(F.col("__h"), names))
    cells = named.select(*[c for c in named.columns if c != "__h"], F.posexplode(rows).alias("__i", "__row"))
    cells = cells.withColumn("__cells", F.array(*[F.try_element_at("__row", F.col(f"__{field}").cast("int")) for field in aliases]))
    # Rows without a value go first, by what is native: a filter on normalised cells would send them to Python twice. NFC leaves no text blank.
    value = F.regexp_replace(F.get("__cells", list(aliases).index("value")), r"(?U)\s+", " ")
    cells = cells.where(blank_to_null(value).isNotNull()).withColumn("__cells", normalize_values(F.col("__cells")))
    cell = lambda field: F.get("__cells", list(aliases).index(field))
    out = cells.withColumns(
        {
            "entity": F.coalesce(cell("entity"), F.lit("UNKNOWN_ENTITY")), "value_raw": cell("value"), "unit": cell("unit"), "reporting_period": F.coalesce(normalize_period(cell("period")), cell("period")),
            "metric": F.coalesce(cell("metric"), F.col("__fallback")), "extraction_method": F.lit(method),
            "source_reference": F.concat("__reference", F.lit(", row "), (F.col("__i") + first_row).cast("string")),
        }
    )
    return _finish(out)


def from_grid(grids: DataFrame, prefix: str = "demo_", aliases: dict = ALIASES) -> DataFrame:
    """Sheets (document_id, sheet_name, grid): the first row is the header."""
    has = grids.where(F.size("grid") > 1)
    return from_rows(
        has, F.element_at("grid", 1), F.slice("grid", 2, F.size("grid")), F.concat(F.lit("sheet "), "sheet_name"), "spreadsheet", F.concat(F.lit(prefix), slug(F.col("sheet_name"))), 2, aliases
    )


def from_tables(sections: DataFrame, prefix: str = "demo_", aliases: dict = ALIASES) -> DataFrame:
    """Sections (document_id, section_index, tables array<struct<table_index, headers, rows>>)."""
    each = sections.select("document_id", "section_index", F.explode("tables").alias("t"))
    reference = F.concat(F.lit("section "), F.col("section_index").cast("string"), F.lit(", table "), F.col("t.table_index").cast("string"))
    return from_rows(each, F.col("t.headers"), F.col("t.rows"), reference, "table", F.lit(prefix + "table_value"), 1, aliases)


def from_ocr(pages: DataFrame) -> DataFrame:
    """One verbatim record a recognised image, for review if flagged or without a confidence."""
    rows = pages.where((F.col("content_type") == "image") & blank_to_null(F.col("extracted_text")).isNotNull())
    return _finish(
        rows.select(
            "document_id", "page_id", F.lit("UNKNOWN_ENTITY").alias("entity"), F.lit("ocr_text").alias("metric"), F.col("extracted_text").alias("value_raw"), F.lit("ocr").alias("extraction_method"),
            F.concat(F.lit("image "), F.col("page_number").cast("string")).alias("source_reference"), F.col("ocr.confidence").cast("double").alias("confidence"),
            (F.col("ocr.confidence").isNull() | F.coalesce(F.col("ocr.review_required"), F.lit(False))).alias("review_required"),
        )
    )


def from_text(pages: DataFrame, max_per_page: int | None = None, separator: str = "\n\n") -> DataFrame:
    """The paragraphs of each page, or the first ones."""
    paragraphs = F.filter(F.split("extracted_text", separator), lambda p: F.trim(p) != "")
    each = pages.select("document_id", "page_id", "page_number", "extraction_status", F.posexplode(F.slice(paragraphs, 1, max_per_page) if max_per_page else paragraphs).alias("i", "p"))
    return _finish(
        each.select(
            "document_id", "page_id", F.lit("UNKNOWN_ENTITY").alias("entity"), F.lit("text_block").alias("metric"), F.trim("p").alias("value_raw"),
            F.when(F.col("extraction_status") == "ocr_extracted", "ocr").otherwise("native_text").alias("extraction_method"),
            F.concat(F.lit("page "), F.col("page_number").cast("string"), F.lit(", block "), (F.col("i") + 1).cast("string")).alias("source_reference"),
        )
    )


def build(pages: DataFrame, max_per_page: int | None = None) -> DataFrame:
    """Every page by the best it has: a grid, else tables, else an image, else text (columns that are missing count as empty)."""
    for c, kind in (("grid", "array<array<string>>"), ("tables", "array<struct<table_index:int,headers:array<string>,rows:array<array<string>>>>"), ("ocr", "struct<confidence:double,review_required:boolean>"), ("sheet_name", "string")):
        if c not in pages.columns:
            pages = pages.withColumn(c, F.lit(None).cast(kind))
    grid, tables = F.coalesce(F.size("grid"), F.lit(0)) > 0, F.coalesce(F.size("tables"), F.lit(0)) > 0
    image = F.coalesce(F.col("content_type") == "image", F.lit(False))
    sections = pages.where(~grid & tables).withColumn("section_index", F.col("page_number"))
    sheets = pages.where(grid).withColumn("sheet_name", F.coalesce("sheet_name", "section_reference", F.lit("sheet")))
    return from_grid(sheets).unionByName(from_tables(sections)).unionByName(from_ocr(pages.where(~grid & ~tables & image))).unionByName(from_text(pages.where(~grid & ~tables & ~image), max_per_page))
