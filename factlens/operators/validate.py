"""Validation: row rules in one scan, group rules as aggregates, outcomes as rows.

A rule is a `Rule`: of kind row it gives array columns of outcome structs, all of which are read in the same pass; of kind group it
turns candidates into outcome rows. The list of rules is an argument, so a user's own rules stand beside the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import blank_to_null, canonical_decimal, normalize_period, parse_date, parse_number
from ..schemas import ERROR, FAILED, PASS, REVIEW_REQUIRED, VALID, WARNING
from .skew import join_key

KEY = ("entity", "reporting_period")
OUTCOME = "rule_code string, status string, severity string, message string, original_value string, expected_value string"


@dataclass(frozen=True)
class Numeric:
    allow_negative: bool = False
    integer_only: bool = False


@dataclass(frozen=True)
class Range:
    minimum: float
    maximum: float
    inclusive: bool = True
    status: str = ERROR


@dataclass(frozen=True)
class Config:
    """Parameters of the built-in rules; fields are columns of the candidates. as_of is what counts as today."""

    as_of: date
    required: dict[str, str] = field(default_factory=lambda: {"entity": ERROR, "reporting_period": WARNING})
    numeric: dict[str, Numeric] = field(default_factory=lambda: {"value_raw": Numeric()})
    ranges: dict[str, Range] = field(default_factory=lambda: {"value_raw": Range(0, 10_000_000)})
    dates: dict[str, bool] = field(default_factory=lambda: {"reporting_period": False})  # whether the future is allowed
    accept_periods: bool = False
    ocr_threshold: float = 0.70
    duplicate_key: tuple[str, ...] = KEY
    consistency_key: tuple[str, ...] = KEY


@dataclass(frozen=True)
class Rule:
    """kind `row`: fn(config) gives a list of outcome columns (NULL: no outcome). kind `group`: fn(candidates, config) gives rows."""

    kind: str
    fn: Callable


def outcome(code: str, status: str, severity: str, message: Column | str, original: Column | None = None, expected: Column | str | None = None) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    return F.struct(
        F.lit(code).alias("rule_code"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), text(message).alias("message"),
        text(original).alias("original_value"), text(expected).alias("expected_value"),
    )


def required(config: Config) -> list[Column]:
    return [F.when(blank_to_null(F.col(f)).isNull(), outcome("REQUIRED_FIELD_MISSING", ERROR, s, f"{f} is missing", F.col(f))) for f, s in config.required.items()]


def numeric(config: Config) -> list[Column]:
    out = []
    for f, spec in config.numeric.items():
        raw, value = blank_to_null(F.col(f)), parse_number(F.col(f))
        bad = F.when(raw.isNotNull() & value.isNull(), outcome("NUMERIC_FORMAT", ERROR, ERROR, f"{f} is not a number", raw))
        if not spec.allow_negative:
            bad = bad.when(value < 0, outcome("NUMERIC_NEGATIVE", ERROR, ERROR, f"{f} is negative", raw, ">= 0"))
        out.append(bad)
        if spec.integer_only:
            out.append(F.when(value != F.floor(value), outcome("NUMERIC_INTEGER_EXPECTED", WARNING, WARNING, f"{f} is not whole", raw, "integer")))
    return out


def in_range(config: Config) -> list[Column]:
    out = []
    for f, r in config.ranges.items():
        value, lo, hi = parse_number(F.col(f)), F.lit(r.minimum).cast("decimal(38,10)"), F.lit(r.maximum).cast("decimal(38,10)")
        inside = value.between(lo, hi) if r.inclusive else (value > lo) & (value < hi)
        out.append(F.when(~inside, outcome("RANGE_OUT_OF_BOUNDS", r.status, r.status, f"{f} is out of range", F.col(f), f"{r.minimum:g}..{r.maximum:g}")))
    return out


def dates(config: Config) -> list[Column]:
    out = []
    for f, allow_future in config.dates.items():
        raw = blank_to_null(F.col(f))
        day = parse_date(raw)
        invalid = raw.isNotNull() & day.isNull()
        if config.accept_periods:
            invalid = invalid & normalize_period(raw).isNull()
        found = F.when(invalid, outcome("DATE_INVALID", WARNING, "info", f"{f} is no date", raw))
        if not allow_future:
            found = found.when(day > F.lit(config.as_of), outcome("DATE_FUTURE", WARNING, WARNING, f"{f} is in the future", raw, config.as_of.isoformat()))
        out.append(found)
    return out


def ocr(config: Config) -> list[Column]:
    low = F.col("confidence") < config.ocr_threshold
    flagged = F.col("confidence").isNull() & F.coalesce(F.col("review_required"), F.lit(False))
    first = F.when(low, outcome("OCR_LOW_CONFIDENCE", REVIEW_REQUIRED, WARNING, "recognised with low confidence", F.col("value_raw"), f">= {config.ocr_threshold}"))
    return [first.when(flagged, outcome("OCR_REVIEW_FLAGGED", REVIEW_REQUIRED, WARNING, "flagged for review by recognition", F.col("value_raw")))]


def _keyed(candidates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys lower-cased and trimmed, NULL as empty; candidates with nothing in any key have no identity."""
    for i, k in enumerate(keys):
        candidates = candidates.withColumn(f"__k{i}", F.coalesce(F.lower(F.trim(F.col(k))), F.lit("")))
    return candidates.where(F.concat(*[f"__k{i}" for i in range(len(keys))]) != "")


def duplicates(candidates: DataFrame, config: Config) -> DataFrame:
    """Second and later records of a key, naming the first. The first is an aggregate with map-side combining, so a key that holds
    a third of all records costs a row a task; the records of such a key find it by a broadcast and spread over the join's tasks."""
    keys = [f"__k{i}" for i in range(len(config.duplicate_key))]
    rows = _keyed(candidates, config.duplicate_key)
    first = rows.groupBy(*keys).agg(F.min(F.struct("record_id", "document_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = join_key(rows, first, keys).where("record_id != first.record_id")
    said = F.concat(F.lit("same key as record "), F.col("first.record_id").cast("string"), F.lit(" of document "), F.col("first.document_id").cast("string"))
    return late.select("record_id", "document_id", outcome("DUPLICATE_DETECTED", WARNING, WARNING, said, F.col("value_raw"), F.col("first.record_id")).alias("o")).select("record_id", "document_id", "o.*")


def conflicts(candidates: DataFrame, config: Config) -> DataFrame:
    """Keys with two or more numbers: the first record against every later one, both values kept."""
    keys = [f"__k{i}" for i in range(len(config.consistency_key))]
    rows = _keyed(candidates, config.consistency_key).withColumn("__v", parse_number(F.col("value_raw"))).where("__v is not null")
    anchor = rows.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.min(F.struct("document_id", "record_id", F.col("value_raw").alias("raw"), F.col("__v").alias("v"))).alias("anchor"), F.count("*").alias("n")).where("lo < hi")
    met = join_key(rows, anchor.drop("lo", "hi"), keys).where("record_id != anchor.record_id")
    said = F.concat(F.lit("record "), F.col("anchor.record_id").cast("string"), F.lit(" has "), canonical_decimal(F.col("anchor.v")), F.lit(", this one "), canonical_decimal(F.col("__v")))
    return met.select("record_id", "document_id", outcome("CROSS_DOCUMENT_CONFLICT", REVIEW_REQUIRED, WARNING, said, F.col("value_raw"), F.col("anchor.raw")).alias("o")).select("record_id", "document_id", "o.*")


DEFAULT_RULES = (Rule("row", required), Rule("row", numeric), Rule("row", in_range), Rule("row", dates), Rule("row", ocr), Rule("group", duplicates), Rule("group", conflicts))


def candidates(records: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Records as candidates: the raw value, or else the number as text. With documents, only records of known ones."""
    out = records.withColumn("value_raw", F.coalesce(blank_to_null(F.col("value_raw")), canonical_decimal(F.col("metric_value")))) if "metric_value" in records.columns else records
    for name, kind in (("confidence", "double"), ("review_required", "boolean")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.join(documents.select("document_id"), "document_id", "left_semi") if documents is not None else out


def ocr_candidates(pages: DataFrame) -> DataFrame:
    """Pages with a recognition result, as candidates without a record."""
    known = (F.col("ocr.confidence").isNotNull() | F.coalesce(F.col("ocr.review_required"), F.lit(False))) & F.col("extraction_status").isin("ocr_extracted", "no_text", "failed")
    return pages.where(known).select(
        F.lit(None).cast("long").alias("record_id"), "document_id", F.col("extracted_text").alias("value_raw"), F.col("ocr.confidence").alias("confidence"), F.col("ocr.review_required").alias("review_required"),
        F.concat_ws(" ", F.coalesce("content_type", F.lit("page")), F.col("page_number").cast("string")).alias("source_reference"),
    )


def row_outcomes(rows: DataFrame, config: Config, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """All row rules in one scan."""
    columns = [c for r in rules if r.kind == "row" for c in r.fn(config)]
    if not columns:
        return rows.sparkSession.createDataFrame([], f"record_id long, document_id long, {OUTCOME}")
    found = F.filter(F.array(*columns), lambda o: o.isNotNull())
    return rows.select("record_id", "document_id", F.inline(found))


def run(rows: DataFrame, config: Config, pages: DataFrame | None = None, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """(record_id, document_id, rule_code, status, severity, message, original_value, expected_value) of all rules."""
    out = row_outcomes(rows, config, rules)
    for r in rules:
        if r.kind == "group":
            out = out.unionByName(r.fn(rows, config))
    return out.unionByName(row_outcomes(ocr_candidates(pages), config, (Rule("row", ocr),))) if pages is not None else out


RANKS = {PASS: 1, WARNING: 2, REVIEW_REQUIRED: 3, ERROR: 4}


def _rank(status: Column) -> Column:
    out = F.lit(0)
    for s, n in RANKS.items():
        out = F.when(status == s, n).otherwise(out)
    return out


def rollup_records(records: DataFrame, outcomes: DataFrame, promote_clean: bool = False) -> DataFrame:
    """Status of each record: an error gives failed, a warning or review gives warning, else as it was (or valid, if clean records
    are promoted)."""
    worst = outcomes.where("record_id is not null").groupBy("record_id").agg(F.max(_rank(F.col("status"))).alias("__w"))
    clean = F.lit(VALID) if promote_clean else F.col("validation_status")
    status = F.when(F.col("__w") == RANKS[ERROR], FAILED).when(F.col("__w") >= RANKS[WARNING], WARNING).when(F.col("__w") == RANKS[PASS], VALID).otherwise(clean)
    return records.join(worst, "record_id", "left").withColumn("validation_status", status).drop("__w")


def rollup_documents(outcomes: DataFrame) -> DataFrame:
    """(document_id, validation_status): error, review_required, warning, pass in this order."""
    worst = outcomes.groupBy("document_id").agg(F.max(_rank(F.col("status"))).alias("w"))
    status = F.lit(None).cast("string")
    for s, n in RANKS.items():
        status = F.when(F.col("w") == n, s).otherwise(status)
    return worst.select("document_id", status.alias("validation_status"))


def summary(outcomes: DataFrame) -> DataFrame:
    s = F.col("status")
    return outcomes.groupBy("document_id").agg(
        F.count("*").alias("total"), F.count_if(s == PASS).alias("passed"), F.count_if(s == WARNING).alias("warnings"), F.count_if(s == ERROR).alias("errors"), F.count_if(s == REVIEW_REQUIRED).alias("review_required"),
    )


def apply_decisions(results: DataFrame, decisions: DataFrame, allowed: tuple[str, ...] = ("open", "in_review", "resolved", "rejected")) -> DataFrame:
    """The latest allowed decision of each result (validation_id, review_status, review_notes, reviewed_at) wins; values stay."""
    latest = decisions.where(F.col("review_status").isin(*allowed)).groupBy("validation_id").agg(F.max(F.struct("reviewed_at", "review_status", "review_notes")).alias("d"))
    base = results.drop("review_status", "review_notes", "reviewed_at")
    return base.join(latest, "validation_id", "left").select(*base.columns, F.coalesce("d.review_status", F.lit("open")).alias("review_status"), "d.review_notes", "d.reviewed_at")


def review_items(results: DataFrame, records: DataFrame) -> DataFrame:
    """Results with a confidence: the record's, else the candidate's."""
    known = records.select("record_id", F.col("confidence").cast("double").alias("__c"))
    own = F.col("confidence").cast("double") if "confidence" in results.columns else F.lit(None).cast("double")
    return results.join(known, "record_id", "left").withColumn("confidence", F.coalesce("__c", own)).drop("__c")


def queue(results: DataFrame, status: str = "open") -> DataFrame:
    return results.where(F.col("review_status") == status)
