"""Report tables: selection, summary, groups and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import blank_to_null, canonical_decimal
from ..schemas import REVIEW_STATUSES
from . import analytics, conflicts as C, insights as I
from .windows import cap_per_key

ORDER = ("entity", "metric", "reporting_period")


def in_order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in ORDER] + [F.col("record_id")]


def select(records: DataFrame, documents: list | None = None, entities: list | None = None, metrics: list | None = None, ids: DataFrame | None = None, **equal) -> DataFrame:
    """AND of IN lists and equalities; a long list of documents comes as a frame and is a semi join."""
    for column, values in (("document_id", documents), ("entity", entities), ("metric", metrics)):
        if values is not None:
            records = records.where(F.col(column).isin(values))
    if ids is not None:
        records = records.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    for column, value in equal.items():
        if value is not None:
            records = records.where(F.col(column) == value)
    return records


explore = select


def listing(selection: DataFrame, n: int) -> DataFrame:
    """The first n rows in report order, and one more if there is one, which tells that the list is cut."""
    return selection.orderBy(*in_order()).limit(n + 1)


def records(selection: DataFrame, documents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Report records with provenance."""
    out = attach(selection, documents, pages)
    if "source_reference" not in out.columns:
        out = out.withColumn("source_reference", F.lit(None).cast("string"))
    return out.withColumn("value_text", value_text()).withColumn("source_label", source_label())


def attach(df: DataFrame, documents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """File name and page number by left joins."""
    out = df.join(documents.select("document_id", "filename"), "document_id", "left")
    if pages is not None and "page_id" in df.columns:
        return out.join(pages.select("page_id", "page_number"), "page_id", "left")
    return out.withColumn("page_number", F.lit(None).cast("int")) if "page_number" not in out.columns else out


def source_label() -> Column:
    """File (doc n) · page n · reference, as far as they are known."""
    file = F.concat(F.coalesce("filename", F.lit("document")), F.lit(" (doc "), F.col("document_id").cast("string"), F.lit(")"))
    return F.concat_ws(" · ", file, F.concat(F.lit("page "), F.col("page_number").cast("string")), "source_reference")


def value_text() -> Column:
    """The raw value, else the normalised one, with its unit; a missing one is said to be missing."""
    value = F.coalesce(blank_to_null(F.col("value_raw")), blank_to_null(F.col("normalized_value")))
    return F.when(value.isNull(), "DATA MISSING").otherwise(F.concat_ws(" ", value, "unit"))


def has_value() -> Column:
    return blank_to_null(F.col("value_raw")).isNotNull() | blank_to_null(F.col("normalized_value")).isNotNull()


def summary(selection: DataFrame, limit: int | None = None) -> DataFrame:
    """One row of counts and distinct entities, metrics, periods (distinct_values lists them), and whether a listing of `limit` is cut."""
    return selection.agg(
        F.count("*").alias("records"), F.countDistinct("document_id").alias("documents"), F.countDistinct("entity").alias("entities"), F.countDistinct("metric").alias("metrics"),
        F.countDistinct("reporting_period").alias("periods"), F.min("reporting_period").alias("first_period"), F.max("reporting_period").alias("last_period"),
        F.count_if(~has_value()).alias("missing"), F.count_if(F.col("validation_status") == "pending").alias("pending"),
        (F.count("*") > F.lit(limit) if limit is not None else F.lit(False)).alias("truncated"),
    )


def distinct_values(selection: DataFrame, fields: tuple[str, ...] = ORDER) -> DataFrame:
    """(field, value, n) of what the selection covers, in order; as rows, so that no list grows with the data."""
    each = selection.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))).where("value is not null")
    return each.groupBy("field", "value").agg(F.count("*").alias("n")).orderBy("field", "value")


def executive_summary(selection: DataFrame, limit: int | None = None, shown: int = 20) -> DataFrame:
    """(n, line): what a selection holds, in sentences; every number is counted, lines that would say nothing are left out. Lists show the
    first `shown` names."""
    flagged = selection.agg(F.count_if(F.col("validation_status").isin(*REVIEW_STATUSES)).alias("flagged"))
    counted = summary(selection, limit).crossJoin(C.conflict_keys(selection).agg(F.count("*").alias("conflicts"))).crossJoin(flagged)
    for name in ("entity", "metric"):
        first = distinct_values(selection, (name,)).limit(shown)
        counted = counted.crossJoin(first.agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias(f"{name}_names")))
    line = lambda on, text: F.when(on, text)
    lines = F.array(
        F.format_string("%d records of %d documents are selected; %d have a value.", "records", "documents", F.col("records") - F.col("missing")),
        line(F.col("entity_names") != "", F.concat(F.lit("Entities: "), "entity_names", F.lit("."))),
        line(F.col("metric_names") != "", F.concat(F.lit("Metrics: "), "metric_names", F.lit("."))),
        line(F.col("conflicts") > 0, F.format_string("REVIEW REQUIRED: %d keys have different values; all are listed, none was chosen.", "conflicts")),
        line(F.col("flagged") > 0, F.format_string("%d records have a warning, an error or await review.", "flagged")),
        line(F.col("pending") > 0, F.format_string("%d records are not validated yet.", "pending")),
        line(F.col("missing") > 0, F.format_string("%d records have no value; nothing was estimated.", "missing")),
        line(F.col("truncated"), F.format_string("The listing is PARTIAL: it shows the first %d records in order.", F.lit(limit or 0))),
    )
    return counted.select(F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("n", "line"))


def analytic_sections(result: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sections of a printed analysis as tables, from the tables of analysis(): indicators, insights, trends, comparisons, charts."""
    status = lambda on: F.when(on, "REVIEW REQUIRED").otherwise("OK").alias("status")
    number = lambda c: canonical_decimal(F.col(c))
    kpis = result["kpis"].select(F.concat_ws(" ", F.initcap("kpi"), "metric", "reporting_period").alias("indicator"), number("value").alias("value"), "unit", status(F.col("review_required")))
    trend = result["trends"]
    point = F.transform("points", lambda p: F.concat(p["reporting_period"], F.lit(": "), canonical_decimal(p["value"])))
    gap = F.transform("gaps", lambda g: F.concat(g, F.lit(": no record")))
    change = F.when(F.col("n_points") < 2, "n/a").when(F.col("percent_change").isNull(), F.concat(number("absolute_change"), F.lit(" (no percentage from a base of 0)"))).otherwise(F.concat(number("absolute_change"), F.lit(" ("), number("percent_change"), F.lit("%)")))
    trends = trend.select(F.concat_ws(" — ", "entity", "metric", "unit").alias("headline"), F.concat(F.array_sort(F.concat(point, gap)), F.array(F.concat(F.lit("change: "), change))).alias("lines"), status(F.col("review_required")))
    compare = result["comparisons"].withColumn("open", F.col("n_valued") < F.col("n_entities"))
    sides = compare.select("metric", "reporting_period", F.inline(F.transform("sides", lambda s: F.struct(s["entity"].alias("entity"), F.coalesce(canonical_decimal(s["value"]), F.lit("no verified value")).alias("value")))), "unit", status(F.col("open")))
    spread = compare.where("difference is not null").select("metric", "reporting_period", F.lit("difference of verified values").alias("entity"), number("difference").alias("value"), "unit", status(F.col("open")))
    return {
        "kpi_summary": kpis,
        "insights": result["insights"].select("kind", "message"),
        "trends": trends,
        "comparisons": sides.unionByName(spread),
        "charts": result["charts"].groupBy("chart", "series").agg(F.count("*").alias("points"), F.count_if(F.col("y").isNull()).alias("gaps")),
    }


def groups(selection: DataFrame, keys: tuple[str, ...] = C.REPORT_KEY, max_ids: int | None = None) -> DataFrame:
    """(keys, n, record_ids in order). One key may hold a third of all records: with max_ids only the first ids of each are gathered, and
    group_members has all of them as rows."""
    if max_ids is None:
        return selection.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("record_id")).alias("record_ids"))
    first = cap_per_key(selection, list(keys), ["record_id"], max_ids).groupBy(*keys).agg(F.sort_array(F.collect_list("record_id")).alias("record_ids"))
    return C.null_safe(selection.groupBy(*keys).agg(F.count("*").alias("n")), first, keys)


def group_members(selection: DataFrame, keys: tuple[str, ...] = C.REPORT_KEY) -> DataFrame:
    """(keys, record_id): the members of groups as rows, in order."""
    return selection.select(*keys, "record_id").sort(*keys, "record_id")


def sections(selection: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Executive summary, key figures, detailed data, validation notes, sources."""
    found = C.detect(selection)
    return {
        "executive_summary": executive_summary(selection),
        "summary": summary(selection).crossJoin(C.conflict_keys(selection).agg(F.count("*").alias("conflicts"))),  # as the executive summary counts them
        "key_figures": groups(selection),
        "detail": records(selection, documents),
        "validation_notes": selection.groupBy("validation_status").agg(F.count("*").alias("n")),
        "conflicts": C.sides(found),
        "sources": selection.groupBy("document_id").agg(F.count("*").alias("n_records")).join(documents.select("document_id", "filename"), "document_id", "left"),
    }


def write_json(tables: dict[str, DataFrame], path: str, compression: str = "gzip") -> None:
    """Sink of a result: JSON lines, a folder for each section; compressed, since every line names its fields, unless "none" is asked for."""
    to_json_rows(tables).write.mode("overwrite").option("compression", compression).partitionBy("section").text(path)


def to_json_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables of a result as (section, payload JSON)."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("payload"))
        out = rows if out is None else out.unionByName(rows)
    return out


def analysis(records_: DataFrame, classified: DataFrame) -> dict[str, DataFrame]:
    """The analytical sections over one classification; pass it stored or persisted, as plans.analysis does."""
    cell = analytics.cells(classified)
    found = C.detect(records_)
    return analysis_tables(records_, classified, found, analytics.exclusions(classified), analytics.aggregates(classified, cell), analytics.trends(classified, cell), analytics.comparisons(classified, cell), analytics.histogram(classified))


def analysis_tables(records_: DataFrame, classified: DataFrame, found: DataFrame, excluded: DataFrame, aggregates: DataFrame, trend: DataFrame, comparison: DataFrame, bins: DataFrame) -> dict[str, DataFrame]:
    said = I.build(records_, found, trend, comparison)
    return {
        "counts": analytics.counts(records_, found),
        "kpis": analytics.kpis_of(aggregates),
        "conflicts": found,
        "trends": trend,
        "comparisons": comparison,
        "distributions": bins,
        "insights": said,
        "charts": I.chart_points(trend, comparison, bins),
        "chart_status": I.chart_status(trend, comparison, bins, excluded),
        "exclusions": excluded,
        "narrative": I.narrative(analytics.totals(records_, found), said),
    }
