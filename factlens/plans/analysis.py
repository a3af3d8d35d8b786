"""Whole analyses as one plan over one classification."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import analytics, conflicts, report


@contextmanager
def analyze(records: DataFrame, max_ids: int | None = None, max_sides: int | None = None) -> Iterator[dict[str, DataFrame]]:
    """All report tables of a selection. What several of them read (the classification, cells, conflicts, exclusions, trends, comparisons) is
    computed once and kept, on disk where memory is short, while the block lasts; what lost executors held is computed again.
    With max_ids lists of records and documents, and with max_sides those of compared entities, hold the first ones only, in charts too;
    numbers are of all."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    try:
        found = keep(conflicts.detect(records, max_ids=max_ids))
        classified = keep(analytics.classify(records, found))
        cell = keep(analytics.cells(classified, max_ids))
        tables = (analytics.exclusions(classified, cell), analytics.aggregates(classified, cell, max_ids=max_ids), analytics.trends(classified, cell), analytics.comparisons(classified, cell, None, max_ids, max_sides), analytics.histogram(classified))
        yield report.analysis_tables(records, classified, found, *map(keep, tables))
    finally:
        for df in kept:
            df.unpersist()


def written(records: DataFrame, path: str, max_ids: int | None = None, max_sides: int | None = None) -> DataFrame:
    """The whole analysis as (section, payload JSON), written to a shared folder and read again."""
    with analyze(records, max_ids, max_sides) as tables:
        report.to_json_rows(tables).write.mode("overwrite").parquet(path)
    return records.sparkSession.read.schema("section string, payload string").parquet(path)
