"""Documents' derived data are replaced and deleted together; actions leave an audit row.

Tables are Parquet folders partitioned by bucket = hash of document_id, and a replacement rewrites only the buckets it touches. Their number is a
property of the table, fixed by its first write: about as many as keep a bucket to one task's work at the size the table is to reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64


def replace(target: DataFrame, batch: DataFrame, keys: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """Target with all rows of the batch's documents replaced by the batch. `keys` names documents that are replaced by nothing too."""
    gone = (batch if keys is None else keys).select(key).distinct()
    return target.join(gone, key, "left_anti").unionByName(batch, allowMissingColumns=True)


def bucketed(df: DataFrame, buckets: int = BUCKETS, key: str = "document_id") -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))


def write_replace(spark: SparkSession, path: str, batch: DataFrame, run_id: str, keys: DataFrame | None = None, buckets: int = BUCKETS, key: str = "document_id") -> None:
    """Replace documents in a stored table. The new state of the touched buckets is written beside the table first and then swapped
    in by dynamic partition overwrite, so a lost executor repeats a task and never half a replacement; the same batch again
    changes nothing. Buckets that have no row any more are dropped. `buckets` counts for the first write, later ones keep what the table has: the number is
    written before the first rows, and a table with rows but without it is refused. Each table is swapped by itself; tables that must change together
    belong in a `store.Store`.
    """
    batch = batch.withColumn("run_id", F.lit(run_id))
    schema = T.StructType([*batch.schema, T.StructField("bucket", T.IntegerType())])
    known = _buckets(spark, path)
    if known is None:
        if _exists(spark, path):
            raise ValueError(f"{path} has rows but no number of buckets in {path}.buckets")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}.buckets")
    buckets = known or buckets
    new = bucketed(batch, buckets, key)
    touched = bucketed((batch if keys is None else keys.select(key).unionByName(batch.select(key))).select(key).distinct(), buckets, key)
    hit = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if _exists(spark, path):
        kept = read_stored(spark, path, schema).where(F.col("bucket").isin(hit)).join(touched.select(key), key, "left_anti")
        new = kept.unionByName(new, allowMissingColumns=True)
    staged = f"{path}.staged/{run_id}"
    new.write.mode("overwrite").parquet(staged)
    state = spark.read.schema(new.schema).parquet(staged)
    filled = {r["bucket"] for r in state.select("bucket").distinct().collect()}
    state.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in set(hit) - filled:  # dynamic overwrite leaves alone what gets no row
        _delete(spark, f"{path}/bucket={bucket}")
    _delete(spark, staged)


def read_stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that write_replace keeps, with the given schema, since one that lost all rows has no file to tell it."""
    names = [f for f in schema if f.name != "bucket"]
    return spark.read.schema(T.StructType([*names, T.StructField("bucket", T.IntegerType())])).parquet(path)


def _buckets(spark: SparkSession, path: str) -> int | None:
    return spark.read.schema("buckets int").parquet(f"{path}.buckets").first()["buckets"] if _exists(spark, f"{path}.buckets/_SUCCESS") else None


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, system = _file(spark, path)
    return system.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, system = _file(spark, path)
    system.delete(p, True)


def delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """All tables without the documents."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def forget_pages(records: DataFrame, deleted_pages: DataFrame) -> DataFrame:
    """Records of deleted pages stay, without the page."""
    gone = deleted_pages.select(F.col("page_id").alias("__p")).distinct()
    return records.join(gone, F.col("page_id") == F.col("__p"), "left").withColumn("page_id", F.when(F.col("__p").isNull(), F.col("page_id"))).drop("__p")


def missing(ids: DataFrame, table: DataFrame, key: str = "document_id") -> DataFrame:
    """Requested ids that the table does not have."""
    return ids.join(table.select(key), key, "left_anti")


def audit_row(spark: SparkSession, action: str, entity_type: str, details: DataFrame) -> DataFrame:
    """One metadata-only row of an action; details is a frame of one row of counts, never of contents."""
    return details.select(F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), F.to_json(F.struct("*")).alias("details"), F.current_timestamp().alias("created_at"))


def audit_append(row: DataFrame, path: str) -> None:
    """Add audit rows to the stored trail, with an id of their own."""
    row.withColumn("audit_id", F.monotonically_increasing_id() + F.unix_micros("created_at")).write.mode("append").parquet(path)


def audit_view(audit: DataFrame, action: str | None = None) -> DataFrame:
    rows = audit.where(F.col("action") == action) if action else audit
    return rows.orderBy(F.desc("created_at"), F.desc("details"))
