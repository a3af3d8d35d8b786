"""Eligibility, KPIs, trends, comparisons and distributions over records.

Every record is classified once; what is excluded is listed with its reason. Arithmetic is on DECIMAL(38,10); averages and
percentages have scale 6. Pass `classify()`'s result, persisted by the caller, to everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import parse_numeric, period_kind, period_sequence
from ..schemas import ELIGIBLE_STATUSES, PENDING, REVIEW_STATUSES
from .conflicts import REPORT_KEY, conflict_keys, null_safe
from .windows import cap_per_key

# Reasons of exclusion.
CONFLICTING = "conflicting_values_not_averaged"
STATUS = "validation_status_error_or_review"
NOT_NUMERIC = "normalized_value_not_numeric"
INCONSISTENT = "inconsistent_values_within_period"
CELL = ("entity", "metric", "unit", "reporting_period")


def classify(records: DataFrame, conflicts: DataFrame | None = None, statuses: tuple[str, ...] = ELIGIBLE_STATUSES) -> DataFrame:
    """Adds value (decimal) and reason (NULL: eligible). Order of reasons: conflict, status, number."""
    keys = (conflict_keys(records) if conflicts is None else conflicts.select(*REPORT_KEY)).withColumn("conflicting", F.lit(True))
    marked = null_safe(records, keys, REPORT_KEY)
    value = parse_numeric(F.col("normalized_value"))
    reason = F.when(F.col("conflicting"), CONFLICTING).when(~F.coalesce(F.col("validation_status").isin(*statuses), F.lit(False)), STATUS).when(value.isNull(), NOT_NUMERIC)
    return marked.withColumn("value", value).withColumn("reason", reason).drop("conflicting")


def counts(records: DataFrame, n_conflicts: DataFrame | None = None) -> DataFrame:
    """One row: records, validated, requires_review, pending, missing, conflicts."""
    status = F.col("validation_status")
    has_value = (F.coalesce(F.trim("value_raw"), F.lit("")) != "") | (F.coalesce(F.trim("normalized_value"), F.lit("")) != "")
    main = records.agg(
        F.count("*").alias("records"), F.count_if(status.isin(*ELIGIBLE_STATUSES)).alias("validated"), F.count_if(status.isin(*REVIEW_STATUSES)).alias("requires_review"),
        F.count_if(~F.coalesce(status.isin(*ELIGIBLE_STATUSES, *REVIEW_STATUSES), F.lit(False))).alias(PENDING), F.count_if(~has_value).alias("missing"),
    )
    found = (conflict_keys(records) if n_conflicts is None else n_conflicts).agg(F.count("*").alias("conflicts"))
    return main.crossJoin(found)  # one row each


def cells(classified: DataFrame, max_ids: int | None = None) -> DataFrame:
    """Eligible records by (entity, metric, unit, period): value where all agree, else NULL and agree = false; with record_ids, document_ids.

    With max_ids only the first records of a cell are gathered. What nobody reads of the lists Spark does not compute.
    """
    eligible = classified.where("reason is null")
    ids = (F.sort_array(F.collect_set("record_id")).alias("record_ids"), F.sort_array(F.collect_set("document_id")).alias("document_ids"))
    bounds = (F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    if max_ids:
        first = cap_per_key(eligible, list(CELL), ["record_id"], max_ids).groupBy(*CELL).agg(*ids)
        grouped = null_safe(eligible.groupBy(*CELL).agg(*bounds), first, CELL)
    else:
        grouped = eligible.groupBy(*CELL).agg(*bounds, *ids)
    agree = F.col("lo") == F.col("hi")
    return grouped.withColumn("agree", agree).withColumn("value", F.when(agree, F.col("lo"))).drop("lo", "hi")


def cell_states(records: DataFrame, statuses: tuple[str, ...] = ELIGIBLE_STATUSES) -> DataFrame:
    """(entity, metric, unit, reporting_period, n_values, n, agree, value): every cell of the records with the number of its raw values, as in conflicts,
    and of its eligible records; agree is NULL where none is. What trends, comparisons and most of a histogram need, of one pass over the records without
    classifying each: a conflict's key is a cell. Sums of numbers only, which Spark hashes, where least texts would be sorted."""
    raw = F.when(F.trim("value_raw") != "", F.col("value_raw")).alias("raw")
    value = F.when(F.col("validation_status").isin(*statuses), parse_numeric(F.col("normalized_value"))).alias("value")
    each = records.select(*CELL, raw, value).groupBy(*CELL, "raw").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    cell = each.groupBy(*CELL).agg(F.count("raw").alias("n_values"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    free = F.col("n_values") < 2
    agree = F.when(free, F.col("lo") == F.col("hi"))
    return cell.select(*CELL, "n_values", F.when(free, F.col("n")).otherwise(0).alias("n"), agree.alias("agree"), F.when(agree, F.col("lo")).alias("value"))


def eligible_rows(records: DataFrame, cell: DataFrame, statuses: tuple[str, ...] = ELIGIBLE_STATUSES) -> DataFrame:
    """(metric, unit, value, n, reason) of all eligible records, for `histogram`: agreeing cells with their number, and the records of the others. `cell` is
    the stored result of cell_states; records are read again only if some cell does not agree."""
    none = F.lit(None).cast("string").alias("reason")
    out = cell.where("agree").select("metric", "unit", "value", "n", none)
    apart = cell.where("not agree").select(*CELL)
    if apart.isEmpty():
        return out
    value = F.when(F.col("validation_status").isin(*statuses), parse_numeric(F.col("normalized_value")))
    rows = null_safe(records.select(*CELL, value.alias("value")).where("value is not null"), apart, CELL, "left_semi")
    return out.unionByName(rows.select("metric", "unit", "value", F.lit(1).cast("long").alias("n"), none))


def exclusions(classified: DataFrame, cell: DataFrame | None = None, repeated: bool = False) -> DataFrame:
    """(record_id, document_id, entity, metric, unit, reporting_period, reason), one row a record and reason. Record ids are taken to be
    unique; where they are not, `repeated` leaves one row of each id and reason, which shuffles all of them."""
    columns = ("record_id", "document_id", *CELL, "reason")
    if cell is None:
        cell = classified.where("reason is null").groupBy(*CELL).agg((F.min("value") == F.max("value")).alias("agree"))
    bad = cell.where("not agree").select(*CELL).withColumn("bad", F.lit(True))
    # One pass over the records: each is rejected for its own reason or for its cell's, so that no record comes twice.
    marked = null_safe(classified, bad, CELL)
    return marked.withColumn("reason", F.coalesce("reason", F.when(F.col("bad"), INCONSISTENT))).where("reason is not null").select(*columns).transform(lambda d: d.dropDuplicates(["record_id", "reason"]) if repeated else d)


def first_ids(df: DataFrame, keys: tuple[str, ...], c: str, max_ids: int) -> DataFrame:
    """(keys, c): the first different ids of each key, of a column of lists. Spark cuts to so many a key before the shuffle."""
    ids = df.select(*keys, F.explode(c).alias("__id")).distinct()
    return cap_per_key(ids, list(keys), ["__id"], max_ids).groupBy(*keys).agg(F.sort_array(F.collect_list("__id")).alias(c))


def aggregates(classified: DataFrame, cell: DataFrame | None = None, max_groups: int | None = None, max_periods: int | None = None, max_ids: int | None = None) -> DataFrame:
    """Total, average, min, max over entities by (metric, unit, period); review_required if the metric and unit have a conflict or the period an
    inconsistent cell. Periods that are NULL are no period. Record ids are of agreeing cells, documents of all: all of them, or the first max_ids
    records and the first max_ids documents of the cells' first records. With max_groups and max_periods the first metrics and units, and the first periods of each."""
    cell = cells(classified, max_ids) if cell is None else cell
    key = ("metric", "unit", "reporting_period")
    timed = cell.where("reporting_period is not null")
    ids = () if max_ids else (
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("agree"), F.col("record_ids"))))).alias("record_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("document_ids")))).alias("document_ids"),
    )
    grouped = timed.groupBy(*key).agg(
        F.try_sum("value").alias("total"), F.try_avg("value").cast("decimal(38,6)").alias("average"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("cells"), F.bool_or(~F.col("agree")).alias("inconsistent"), *ids,
    )
    if max_ids:
        for c, of in (("record_ids", timed.where("agree")), ("document_ids", timed)):
            grouped = null_safe(grouped, first_ids(of, key, c, max_ids), key)
    hit = classified.where(F.col("reason") == CONFLICTING).select("metric", "unit").distinct().withColumn("conflicted", F.lit(True))
    marked = null_safe(cap_groups(grouped.where("cells > 0"), ("metric", "unit"), ("reporting_period",), max_groups, max_periods), hit, ("metric", "unit"))
    return marked.withColumn("review_required", F.col("inconsistent") | F.coalesce("conflicted", F.lit(False))).drop("inconsistent", "conflicted")


def kpis(classified: DataFrame, top: int | None = None, max_ids: int | None = None) -> DataFrame:
    """Aggregates in long form: (metric, unit, reporting_period, kpi, value, ...), or the first ones in order."""
    return kpis_of(aggregates(classified, max_ids=max_ids), top)


def kpis_of(wide: DataFrame, top: int | None = None) -> DataFrame:
    values = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("decimal(38,6)").alias("value")) for k in ("total", "average", "min", "max")])
    return wide.select("metric", "unit", "reporting_period", "review_required", "cells", "record_ids", "document_ids", F.inline(values)).transform(lambda d: d.orderBy("metric", "unit", "reporting_period", "kpi").limit(top) if top else d)


def count_sources(records: DataFrame) -> DataFrame:
    """(kpi, record_id, document_id): the records that each count of counts() counts, as rows."""
    status = F.col("validation_status")
    has_value = (F.coalesce(F.trim("value_raw"), F.lit("")) != "") | (F.coalesce(F.trim("normalized_value"), F.lit("")) != "")
    known = F.coalesce(status.isin(*ELIGIBLE_STATUSES, *REVIEW_STATUSES), F.lit(False))
    kinds = F.array(F.lit("records"), F.when(status.isin(*ELIGIBLE_STATUSES), "validated"), F.when(status.isin(*REVIEW_STATUSES), "requires_review"), F.when(~known, PENDING), F.when(~has_value, "missing"))
    return records.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kpi"), "record_id", "document_id")


def trends(classified: DataFrame | None, cell: DataFrame | None = None, top: int | None = None, max_ids: int | None = None) -> DataFrame:
    """One row a series (entity, metric, unit) with agreeing points: first and last, changes, direction, missing periods.

    percent_change only from a base other than 0. Gaps are looked for if all points are years, or all months. review_required
    if any record of the series is excluded. NULL periods are no points, entities that are NULL no series. With max_ids a point has its first records.
    Of cell_states alone (classified is None) there are no record ids and no review_required.
    """
    cell = cells(classified, max_ids) if cell is None else cell
    series = ("entity", "metric", "unit")
    points = cell.where("agree and reporting_period is not null and entity is not null")
    held = [c for c in ("reporting_period", "value", "record_ids") if c in cell.columns]
    # All is read from the sorted points: a period has one point.
    grouped = points.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("points"))
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    kinds = F.array_distinct(F.transform("points", lambda p: F.coalesce(period_kind(p["reporting_period"]), F.lit(""))))
    grouped = grouped.select(
        *series, first["reporting_period"].alias("first_period"), last["reporting_period"].alias("last_period"),
        first["value"].alias("first_value"), last["value"].alias("last_value"), F.size("points").cast("long").alias("n_points"), "points", kinds.alias("kinds"),
    )
    change = F.col("last_value") - F.col("first_value")
    wanted = period_sequence(F.col("first_period"), F.col("last_period"))
    same = (F.size("kinds") == 1) & (F.get("kinds", F.lit(0)) != "")
    gaps = F.when(same, F.array_except(wanted, F.transform("points", lambda p: p["reporting_period"]))).otherwise(F.array().cast("array<string>"))
    out = grouped.withColumn("absolute_change", change)
    out = out.withColumn("percent_change", F.when(F.col("first_value") != 0, F.try_divide(change * 100, F.col("first_value")).cast("decimal(38,6)")))
    out = out.withColumn("direction", F.when(F.col("n_points") < 2, "insufficient").when(change > 0, "increasing").when(change < 0, "decreasing").otherwise("unchanged")).withColumn("gaps", gaps).drop("kinds")
    if classified is not None:
        # A record is excluded by its own reason or because its cell does not agree.
        own = classified.where("reason is not null").select(*series)
        excluded = own.unionByName(cell.where("not agree").select(*series)).distinct().withColumn("review_required", F.lit(True))
        out = null_safe(out, excluded, series).withColumn("review_required", F.coalesce("review_required", F.lit(False)))
    return out.orderBy(*series).limit(top) if top else out


def comparisons(classified: DataFrame | None, cell: DataFrame | None = None, top: int | None = None, max_ids: int | None = None, max_sides: int | None = None) -> DataFrame:
    """Entities side by side by (metric, unit, period), those with only excluded records with a NULL value; two entities at least. With max_ids a
    side has its first records, with max_sides only the first entities are listed; counts and the difference are of all. Of cell_states alone
    (classified is None) sides have no record ids."""
    cell = cells(classified, max_ids) if cell is None else cell
    key = ("metric", "unit", "reporting_period")
    if classified is None:
        side = cell.where("entity is not null").select(*CELL, "value")
    else:
        named = classified.where("entity is not null")
        listed = cap_per_key(named, ["entity", *key], ["record_id"], max_ids) if max_ids else named
        everyone = listed.groupBy("entity", *key).agg(F.sort_array(F.collect_set("record_id")).alias("record_ids"))
        side = null_safe(everyone, cell.select(*CELL, "value"), ("entity", *key))
    sides = F.array_sort(F.collect_list(F.struct(*[c for c in ("entity", "value", "record_ids") if c in side.columns]))).alias("sides")
    grouped = side.groupBy(*key).agg(
        F.count("*").alias("n_entities"), F.count("value").alias("n_valued"), F.max("value").alias("hi"), F.min("value").alias("lo"), *([] if max_sides else [sides]),
    )
    if max_sides:
        grouped = null_safe(grouped, cap_per_key(side, list(key), ["entity"], max_sides).groupBy(*key).agg(sides), key)
    out = grouped.where("n_entities >= 2").withColumn("difference", F.when(F.col("n_valued") >= 2, F.col("hi") - F.col("lo"))).drop("hi", "lo")
    return out.orderBy(*key).limit(top) if top else out


def histogram(classified: DataFrame, bins: int = 5, max_groups: int | None = None) -> DataFrame:
    """(metric, unit, bin, low, high, n): equal-width bins over all eligible records, the last one closed, one bin if all are equal. Where the rows
    have an `n` they stand for so many records."""
    rows = classified.where("reason is null").select("metric", "unit", "value", F.col("n") if "n" in classified.columns else F.lit(1).alias("n"))
    bounds = cap_groups(rows.groupBy("metric", "unit").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), ("metric", "unit"), (), max_groups)
    width = ((F.col("hi") - F.col("lo")) / bins).cast("decimal(38,10)")
    bounds = bounds.withColumn("width", width).withColumn("last", F.when(F.col("hi") > F.col("lo"), bins - 1).otherwise(0))
    place = F.when(F.col("last") == 0, 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")).cast("int"), F.col("last")))
    counted = null_safe(rows, bounds, ("metric", "unit"), "inner").withColumn("bin", place).groupBy("metric", "unit", "bin").agg(F.sum("n").alias("n"))
    frame = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("last"))))
    edge = lambda k: (F.col("lo") + F.col("width") * k).cast("decimal(38,10)")
    out = null_safe(frame, counted, ("metric", "unit", "bin"))
    return out.select("metric", "unit", "bin", edge(F.col("bin")).alias("low"), F.when(F.col("bin") == F.col("last"), F.col("hi")).otherwise(edge(F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def totals(records: DataFrame, conflicts: DataFrame, statuses: tuple[str, ...] = REVIEW_STATUSES) -> DataFrame:
    """One row: records, flagged, conflicts."""
    flagged = F.count_if(F.col("validation_status").isin(*statuses))
    return records.agg(F.count("*").alias("records"), flagged.alias("flagged")).crossJoin(conflicts.agg(F.count("*").alias("conflicts")))


def cap_groups(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], groups: int | None = None, per_group: int | None = None) -> DataFrame:
    """Output caps: the first `groups` keys in order, and the first rows of each. None: no cap."""
    if groups:
        chosen = df.select(*keys).distinct().orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(groups)
        df = null_safe(df, chosen, keys, "left_semi")
    if per_group:
        df = df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= per_group).drop("__n")
    return df


def id_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
