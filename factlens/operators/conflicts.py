"""Conflicts: one key, several raw values. None wins; all sides stay listed with their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .windows import cap_per_key

REPORT_KEY = ("entity", "metric", "reporting_period", "unit")
EVIDENCE_KEY = ("entity", "metric", "reporting_period")


def null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """Join on keys in which NULL equals NULL; right's keys are dropped. Spark plans this as a hash join."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition: Column = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def conflict_keys(records: DataFrame, keys: tuple[str, ...] = REPORT_KEY) -> DataFrame:
    """Keys with two or more raw values. Two values suffice to tell, so only the least and the greatest are kept on the way."""
    valued = records.where(F.trim("value_raw") != "")
    return valued.groupBy(*keys).agg(F.min("value_raw").alias("a"), F.max("value_raw").alias("b")).where("a < b").select(*keys)


def detect(records: DataFrame, keys: tuple[str, ...] = REPORT_KEY, max_ids: int | None = None) -> DataFrame:
    """One row a conflict: keys, n_values, n_records, values array<struct<first_record_id, value_raw, normalized_value, record_ids, document_ids>>.

    Values stand in order of their first record. Only keys that conflict are gathered, so a big agreeing group costs one row; with
    max_ids only the first records of each value are.
    """
    valued = null_safe(records.where(F.trim("value_raw") != ""), conflict_keys(records, keys), keys, "left_semi")
    bounds = (F.min("record_id").alias("first_record_id"), F.min("normalized_value").alias("normalized_value"), F.count("*").alias("n"))
    ids = (F.sort_array(F.collect_list("record_id")).alias("record_ids"), F.sort_array(F.collect_set("document_id")).alias("document_ids"))
    value = (*keys, "value_raw")
    if max_ids:
        first = cap_per_key(valued, list(value), ["record_id"], max_ids).groupBy(*value).agg(*ids)
        each = null_safe(valued.groupBy(*value).agg(*bounds), first, value)
    else:
        each = valued.groupBy(*value).agg(*bounds, *ids)
    side = F.struct("first_record_id", "value_raw", "normalized_value", "record_ids", "document_ids")
    return each.groupBy(*keys).agg(F.count("*").alias("n_values"), F.sum("n").alias("n_records"), F.array_sort(F.collect_list(side)).alias("values"))


def sides(conflicts: DataFrame, keys: tuple[str, ...] = REPORT_KEY) -> DataFrame:
    """One row a value of a conflict, with its position."""
    return conflicts.select(*keys, F.posexplode("values").alias("position", "side")).select(*keys, "position", "side.*")


def per_document(conflicts: DataFrame, keys: tuple[str, ...] = REPORT_KEY) -> DataFrame:
    """(document_id, conflicts): in how many conflicts a document stands."""
    named = conflicts.select(F.xxhash64(*[F.coalesce(F.col(k), F.lit("\x00")) for k in keys]).alias("c"), F.explode("values").alias("v"))
    return named.select("c", F.explode("v.document_ids").alias("document_id")).distinct().groupBy("document_id").agg(F.count("*").alias("conflicts"))
