"""Sentences, chart points and a narrative, derived from analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import canonical_decimal
from ..schemas import REVIEW_STATUSES
from .conflicts import null_safe

# Kinds in the order they are shown.
KINDS = ("CONFLICT", "VALIDATION_WARNING", "DATA_GAP", "TREND", "COMPARISON")


def _name(c: str):
    return F.coalesce(F.col(c), F.lit("?"))


def build(records: DataFrame, conflicts: DataFrame, trends: DataFrame, comparisons: DataFrame, top: int | None = 60, max_missing: int | None = None, max_gaps: int | None = None) -> DataFrame:
    """(kind_rank, kind, message) in order; nothing is said that a row does not hold."""
    where = F.concat_ws(" ", _name("entity"), _name("metric"), F.coalesce("reporting_period", F.lit("no period")))
    parts = [
        conflicts.select(F.lit(0).alias("kind_rank"), F.concat(where, F.lit(": "), F.col("n_values").cast("string"), F.lit(" different values reported")).alias("message")),
        records.where(F.col("validation_status").isin(*REVIEW_STATUSES)).groupBy("metric", "validation_status").agg(F.count("*").alias("n")).select(
            F.lit(1).alias("kind_rank"), F.concat(_name("metric"), F.lit(": "), F.col("n").cast("string"), F.lit(" records with status "), F.col("validation_status")).alias("message")
        ),
        records.where((F.coalesce(F.trim("value_raw"), F.lit("")) == "") & (F.coalesce(F.trim("normalized_value"), F.lit("")) == "")).transform(lambda d: d.orderBy("record_id").limit(max_missing) if max_missing else d).select(
            F.lit(2).alias("kind_rank"), F.concat(where, F.lit(": no value")).alias("message")
        ),
        trends.where(F.size("gaps") > 0).select(
            F.lit(2).alias("kind_rank"),
            F.concat(_name("entity"), F.lit(" "), _name("metric"), F.lit(": no data for "), F.array_join(F.slice("gaps", 1, max_gaps) if max_gaps else F.col("gaps"), ", ")).alias("message"),
        ),
        trends.where(F.col("n_points") >= 2).select(
            F.lit(3).alias("kind_rank"),
            F.concat(
                _name("entity"), F.lit(" "), _name("metric"), F.lit(" "), F.col("direction"), F.lit(" from "), canonical_decimal(F.col("first_value")), F.lit(" in "), F.col("first_period"),
                F.lit(" to "), canonical_decimal(F.col("last_value")), F.lit(" in "), F.col("last_period"),
            ).alias("message"),
        ),
        comparisons.where("difference is not null").select(
            F.lit(4).alias("kind_rank"),
            F.concat(_name("metric"), F.lit(" "), F.coalesce("reporting_period", F.lit("no period")), F.lit(": spread of "), canonical_decimal(F.col("difference")), F.lit(" over "), F.col("n_valued").cast("string"), F.lit(" entities")).alias("message"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_rank") + 1)).orderBy("kind_rank", "message")
    return out.limit(top) if top else out


def chart_points(trends: DataFrame, comparisons: DataFrame, histogram: DataFrame, cell: DataFrame | None = None) -> DataFrame:
    """One tidy table (chart, series, x, y): lines with NULL at gaps, bars of bins, bars of compared entities. With the cells of all records
    (cell_states) the compared entities are read from them, so no row holds all entities of a period."""
    cast = lambda c: c.cast("decimal(38,10)")
    line = trends.select(
        F.concat_ws("/", F.lit("line"), "metric", "unit").alias("chart"), F.col("entity").alias("series"),
        F.inline(F.concat(
            F.transform("points", lambda p: F.struct(p["reporting_period"].alias("x"), cast(p["value"]).alias("y"))),
            F.transform("gaps", lambda g: F.struct(g.alias("x"), F.lit(None).cast("decimal(38,10)").alias("y"))),
        )),
    )
    bars = histogram.select(F.concat_ws("/", F.lit("bins"), "metric", "unit").alias("chart"), F.lit("count").alias("series"), F.col("bin").cast("string").alias("x"), cast(F.col("n")).alias("y"))
    chart, series = F.concat_ws("/", F.lit("compare"), "metric", "unit").alias("chart"), F.coalesce("reporting_period", F.lit("")).alias("series")
    if cell is not None:
        key = ("metric", "unit", "reporting_period")
        sides = null_safe(cell.where("entity is not null"), comparisons.select(*key), key, "left_semi").select(chart, series, F.col("entity").alias("x"), cast(F.col("value")).alias("y"))
        return line.unionByName(bars).unionByName(sides)
    sides = comparisons.select(
        chart, series,
        F.inline(F.transform("sides", lambda s: F.struct(s["entity"].alias("x"), cast(s["value"]).alias("y")))),
    )
    return line.unionByName(bars).unionByName(sides)


def chart_status(trends: DataFrame, comparisons: DataFrame, histogram: DataFrame, exclusions: DataFrame, top: int | None = 30) -> DataFrame:
    """(kind, chart, series, status, note): every chart of chart_points, in order, with ok or review_required and why."""
    flag = lambda on: F.when(on, "review_required").otherwise("ok").alias("status")
    why = lambda on, text: F.when(on, text).alias("note")
    line = trends.select(F.lit(0).alias("kind"), F.concat_ws("/", F.lit("line"), "metric", "unit").alias("chart"), F.col("entity").alias("series"), flag(F.col("review_required")), why(F.col("review_required"), F.lit("excluded values are not drawn")))
    left_out = exclusions.groupBy("metric", "unit").agg(F.count("*").alias("left_out"))
    drawn = null_safe(histogram.select("metric", "unit").distinct(), left_out, ("metric", "unit"))
    some = F.coalesce("left_out", F.lit(0)) > 0
    bars = drawn.select(F.lit(1).alias("kind"), F.concat_ws("/", F.lit("bins"), "metric", "unit").alias("chart"), F.lit("count").alias("series"), flag(some), why(some, F.format_string("%d values are not counted", F.coalesce("left_out", F.lit(0)))))
    gap = F.col("n_valued") < F.col("n_entities")
    sides = comparisons.select(F.lit(2).alias("kind"), F.concat_ws("/", F.lit("compare"), "metric", "unit").alias("chart"), F.coalesce("reporting_period", F.lit("")).alias("series"), flag(gap), why(gap, F.lit("entities without a verified value are gaps")))
    out = line.unionByName(bars).unionByName(sides).orderBy("kind", "chart", "series")
    return out.limit(top) if top else out


def narrative(totals: DataFrame, insights: DataFrame, top: int = 5) -> DataFrame:
    """One row: a paragraph of counts and the first insights."""
    first = insights.orderBy("kind_rank", "message").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind_rank", "message"))), lambda m: m["message"]), ". ").alias("said"))
    counted = F.format_string("%d records, %d flagged for review, %d conflicts.", "records", "flagged", "conflicts")
    return totals.crossJoin(first).select(F.concat_ws(" ", counted, "said").alias("narrative"))
