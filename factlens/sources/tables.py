"""Scans of the engine's tables, with explicit schemas and only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES


def read(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """The named table under root; a known one with its declared schema, so that no file is opened to infer it."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    table = reader.parquet(f"{root}/{name}")
    return table.select(*columns) if columns else table


def write(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(f"{root}/{name}")


def spread(scan: DataFrame, few: int = 32) -> DataFrame:
    """A scan of fewer splits than cores, and of few, is dealt out over the cores before costly expressions: files of one row group are read by one task
    however long they are. Larger scans stay as they are. For plain scans: counting the splits of other plans would run a part of them."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < min(cores, few) else scan
