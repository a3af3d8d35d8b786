"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint within `distance` bits of another one agrees with it, but for one bit at most, in at least one of
`(distance + 1) // 2` segments, rounded up. Every distinct fingerprint is therefore indexed under each segment with each
of its bits left out in turn; equal keys meet in a join, which keeps the pairs that really are near. With distance 3
these are two segments of 32 bits and 64 keys, where exact segments would need four short ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, encode, materialize
from .components import components

BITS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    parts = encode(text).lower().split()  # bytes.lower() maps A-Z only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: -words].tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())])
    count, ones = len(starts), np.zeros(BITS, np.int64)
    for at in range(0, count, 4096):  # bounded memory for very long texts
        ones += np.unpackbits(np.frombuffer(raw[at * 8 : (at + 4096) * 8], np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; null and empty texts get 0."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, length) of the segments, of which one must differ by one bit at most."""
    n = max(2, -(-(distance + 1) // 2))  # two at least, so that a segment's numbers stay below the sign bit
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (u < v) of distinct fingerprints of a frame with a column fp that differ in `distance` bits or fewer, each once."""
    segments = _segments(distance)
    variants = []
    for k, (low, size) in enumerate(segments):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1))
        for w in range(size):
            rest = part.bitwiseAND(F.lit(~(1 << w)))
            variants.append(F.struct(F.lit(k * BITS + w).cast("short").alias("slot"), rest.alias("rest")))
    # The distinct fingerprints are few megabytes, which would be left in a task or two, and each becomes 64 rows.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select("fp").distinct().repartition(tasks, "fp").select("fp", F.inline(F.array(*variants)))
    # Merged by sort: Spark takes the size of a scan or a shuffle of fingerprints for that of their 64 keys and would send all keys to the driver.
    a, b = keyed.alias("a").hint("merge"), keyed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    slot = F.col("a.slot").cast("int")
    # A pair may meet under many keys; one is its own: the first segment that differs by a bit at most, without that bit.
    own, earlier = F.lit(False), F.lit(True)
    for k, (low, size) in enumerate(segments):
        diff = F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << size) - 1))
        left_out = F.when(diff == 0, F.lit(k * BITS)).otherwise(F.lit(k * BITS) + F.bit_count(diff - 1))
        own = own | (earlier & (F.bit_count(diff) <= 1) & (slot == left_out))
        earlier = earlier & (F.bit_count(diff) > 1)
    near = F.bit_count(x) <= distance
    joined = a.join(b, (F.col("a.slot") == F.col("b.slot")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.fp") < F.col("b.fp")) & near & own)
    return joined.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: id, fp, component_id (least id reachable over links of `distance` bits or fewer).

    Rows with equal fingerprints form one class and meet only as that class, so that thousands of copies cost one index
    entry. Null ids keep their row and never become a component_id unless all ids of the component are null. Texts
    without words share fingerprint 0 and are linked like others.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words), "fps")
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = materialize(links(fps, distance), "links")
    roots = components(found)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.where("root != fp").groupBy("root").agg(F.min("least").alias("others"))
    heads = rooted.where("root = fp").join(least, "root", "left").select("root", F.least("least", "others").alias("component_id"))
    ids = rooted.select("fp", "root").join(heads, "root").select("fp", "component_id")
    discard(found)
    return fps.join(ids, "fp").select(id_col, "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """The documents with one kept of each group: the one of least id (rows that repeat an id stay together)."""
    groups = near_duplicates(docs, id_col, text_col, words, distance).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = groups.select(F.col(id_col).alias("__keep")).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi")


def labels(rows: DataFrame) -> DataFrame:
    """(place, label) of rows (place, text): rows of one component of fingerprints have one label."""
    return near_duplicates(rows, "place").select("place", F.xxhash64("component_id").alias("label"))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: documents, 3-word shingles, 3 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
