"""Duplicates on arriving records: the first one of a key is kept in state, later ones are emitted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "record_id long, document_id long, rule_code string, status string, first_record_id long"
#: transformWithState keeps its state in RocksDB, on disk, so the number of keys is not bounded by memory.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """State of a key: the id of its first record, forgotten `ttl` milliseconds after it was written last."""

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", T.StructType([T.StructField("record_id", T.LongType())]), self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        if self.first.exists():
            first = int(self.first.get()[0])
            late: Iterator[pd.DataFrame] = rows
        else:
            new = pd.concat(list(rows)).sort_values("record_id")
            first, late = int(new.record_id.iloc[0]), iter([new.iloc[1:]])
        if self.ttl or not self.first.exists():
            self.first.update((first,))  # with a ttl, what is touched lives on
        for some in late:
            out = some[some.record_id != first][["record_id", "document_id"]].assign(rule_code="DUPLICATE_DETECTED", status="warning", first_record_id=first)
            yield out.astype({"rule_code": object, "status": object, "first_record_id": "int64"})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.first.update((int(initialState.record_id.min()),))

    def close(self) -> None:
        pass


def _keyed(records: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    keyed = records.withColumns({f"k{i}": F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for i, k in enumerate(keys)})
    return keyed.where(F.concat(*[f"k{i}" for i in range(len(keys))]) != "")


def flag_duplicates(source: DataFrame, keys: tuple[str, ...] = ("entity", "reporting_period"), ttl: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Later records of a key, naming the first that arrived (inside a micro-batch: that of least id). With a ttl (milliseconds as
    text) a key that nothing touches for so long is forgotten; such a stream needs a trigger by processing time, since Spark then runs batches without
    data too, and with availableNow would never end. `known`, a table of stored records, is what a new checkpoint starts from: their keys' least
    ids come first, and a known record that arrives again is no duplicate of itself. Order is that of arrival, which batch validation does not know. Records
    with nothing in any key have no identity, as in batch validation, and are never flagged. A known key's
    records pass batch by batch; of a new key one micro-batch (which the source's rate bounds) is held, since its least id comes first."""
    names = [f"k{i}" for i in range(len(keys))]
    source.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    before = None
    if known is not None:
        before = _keyed(known, keys).groupBy(*names).agg(F.min("record_id").alias("record_id")).groupBy(*names)
    rows = _keyed(source, keys).select(*names, "record_id", "document_id")
    return rows.groupBy(*names).transformWithStateInPandas(FirstOfKey(int(ttl) if ttl else None), OUT, "Append", "ProcessingTime" if ttl else "None", before)
