"""Incremental ingest: arriving pages become records, outcomes and units, which replace what their documents had, all tables in one commit.

A document's state is all pages of its latest version, whichever batches brought them: late pages of an older version lose, pages of the version
that is stored join it. So the same batches in any order end in the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import records as R, units as U, validate as V
from ..sources import lifecycle
from ..sources.store import Store


def merged(stored: DataFrame, batch: DataFrame, version: str, files: DataFrame, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pages of each document's latest version, of what is stored and what arrives, with their file name; null is before all versions. A page that differs
    between arrivals of one version counts once, by the content of greater hash, so that the order does not matter.

    `deal` adds the bucket of documents and brings a bucket's rows into one task. Texts are moved by it and by nothing else, which is why names
    (document_id, filename) come as rows between the pages and not by a join."""
    both = stored.unionByName(batch.select(stored.columns)).withColumn("__page", F.lit(True))
    rows = deal(both.unionByName(files.withColumn("__page", F.lit(False)), allowMissingColumns=True).where("document_id is not null"))
    document = W.partitionBy("bucket", "document_id")
    told = rows.withColumns({"__v": F.max(version).over(document), "filename": F.max("filename").over(document)})
    newest = told.where(F.col("__page") & F.col(version).eqNullSafe(F.col("__v")))
    row = F.struct(*stored.columns, "filename")
    return newest.groupBy("bucket", "document_id", "page_id").agg(F.max_by(row, F.xxhash64(*stored.columns)).alias("row")).select("row.*")


def derive(pages: DataFrame, config: V.Config, max_per_page: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records (with an id from their content and place) and row outcomes of pages."""
    rows = R.build(pages, max_per_page).withColumn("record_id", F.xxhash64("document_id", "source_reference", "value_raw")).withColumn("validation_status", F.lit("pending"))
    return rows, V.row_outcomes(rows, config)


def derived(pages: DataFrame, config: V.Config, documents: DataFrame | None, version: str = "version", max_per_page: int | None = None) -> dict[str, DataFrame]:
    """All tables of pages, by name. Without documents the pages have their file name; no row then leaves its task."""
    plain = pages.drop(version)
    rows, outcomes = derive(plain, config, max_per_page)
    units = U.page_units(plain, documents).unionByName(U.record_units(rows)).unionByName(U.validation_units(outcomes))
    return {"pages": pages, "records": rows, "outcomes": outcomes, "units": units}


def tables(spark: SparkSession, root: str, pages: DataFrame, config: V.Config, documents: DataFrame, version: str = "version", buckets: int = lifecycle.BUCKETS, max_per_page: int | None = None) -> Store:
    """The store that ingest keeps under root, for pages of this schema."""
    none = spark.createDataFrame([], pages.schema)
    return Store(spark, root, {name: df.schema for name, df in derived(none, config, documents, version, max_per_page).items()}, buckets)


def ingest(source: DataFrame, root: str, checkpoint: str, config: V.Config, documents: DataFrame, version: str = "version", buckets: int = lifecycle.BUCKETS, max_per_page: int | None = None, keep: int = 1) -> StreamingQuery:
    """Start the stream of pages (with a version column). Each micro-batch is one commit of all tables under root; a batch that runs again
    after a failure changes nothing. Folders of the last `keep` states stay: with 1 the tables' folders hold what is current and nothing else, and a reader
    that is under way when a batch commits may have to begin again; with more it can end."""

    schemas = tables(source.sparkSession, root, source, config, documents, version, buckets, max_per_page).schemas

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, root, schemas, buckets)
        state = store.state()
        stream = spark.read.text(f"{checkpoint}/metadata").first()[0]  # a new checkpoint has a new id, its batches are new runs
        ids = batch.select("document_id").distinct()
        # Everything is made of the pages where they lie. Only they are kept for it: what is derived is larger.
        files = documents.select("document_id", "filename")
        pages = merged(store.rows_of("pages", ids, state), batch, version, files, lambda rows: store.dealt(rows, state.buckets)).persist()
        try:
            store.commit(derived(pages, config, None, version, max_per_page), f"{stream} {number}", ids, placed=True)
            store.vacuum(keep)
        finally:
            pages.unpersist()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
