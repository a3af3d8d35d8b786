"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but ASCII white space: bytes.split() splits on exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Base of the rolling polynomial hash (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir. Where it is unset only a local master, which has no other
    machines, may use one of its own; elsewhere executors would write where the driver does not read."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: What materialize() has written in each open passing().
_OPEN: list[list[DataFrame]] = []


@contextmanager
def passing():
    """Within it materialize() writes what only passes: at its end all of it goes but the frames that were put into the list it gives."""
    kept: list[DataFrame] = []
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield kept
    finally:
        _OPEN.remove(made)
        stay = {getattr(df, "_llm_path", None) for df in kept}
        for df in made:
            if df._llm_path not in stay:
                discard(df)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage and survives lost executors. What discard() does not
    delete before goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    target, system = _path(spark, path)
    system.deleteOnExit(target)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._llm_path = path
    for made in _OPEN:
        made.append(back)
    return back


def discard(df: DataFrame | None) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        target, system = _path(df.sparkSession, path)
        system.delete(target, True)


class Rolling:
    """Hashes of all runs of n consecutive values, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 4096, 2 * len(self.power))
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 2**64))):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], whatever stands before."""
        return (sums[end] - sums[start]) * self.inverse[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, so that comparing them orders them at random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
