"""Nearest neighbours by shifted space-filling curves.

Several orderings: each projects the unit vectors on a few random directions, shifts and cuts them to a grid, and numbers
the cells along a Hilbert curve. Spark range-partitions the rows by (ordering, Hilbert number); inside a partition every query is
compared with the `window` rows before and after it. Candidates of all orderings merge, and each query keeps its best.

In high dimensions without structure the windows alone miss many neighbours (figures in the README), so they are not the
last word: they give each query a floor, the score of its k-th best candidate. Rows and queries are then packed in blocks along the first
curve, each block a cap of a direction and a radius. Caps are compared before anything is copied: a block of queries is sent only to the
blocks of rows whose caps may hold something over its lowest floor; there a query whose own floor rules the block out is skipped,
the rest is multiplied out and only what reaches the floor leaves the task. The result is therefore exact; structure in the
data makes it cheap. No block keeps more than k rows of a query, and no key stands for more than a block of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize

DIMS, BITS_EACH, ORDERINGS, WINDOW = 5, 6, 4, 64
QUERY_BLOCK, ROW_BLOCK = 1024, 2048
#: About how many blocks of rows one copy of a block of queries is sent to.
FAN = 256


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of grid coordinates, each below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level, from the coarsest to the finest
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _usable(v: Column) -> Column:
    """Neither null nor zero, and all components numbers."""
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & good & F.exists(v, lambda c: c != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -score, q))
    first = np.r_[0, np.flatnonzero(np.diff(q[order])) + 1] if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def _pairs(q_ids, q_rows, ids, rows, floor, k):
    """Best of rows for each query of a block that reach its floor, scored exactly; equal ids are not compared."""
    s = unit(q_rows) @ unit(rows).T
    s[q_ids[:, None] == ids[None, :]] = -9
    if s.shape[1] > k:
        floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
    a, b = np.nonzero(s >= np.maximum(floor, -2)[:, None] - 1e-9)
    parts = [cosine(q_rows[a[i : i + 100_000]], rows[b[i : i + 100_000]]) for i in range(0, len(a), 100_000)]
    score = np.concatenate(parts) if parts else np.zeros(0)
    keep = _best(q_ids[a], ids[b], score, k)
    return q_ids[a[keep]], ids[b[keep]], score[keep]


def _found(q, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def _merge(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def ordered(rows: DataFrame, dims: int, seed: int = 7) -> DataFrame:
    """(curve, key, id, v, asks) of every row under every ordering, range-partitioned and sorted along the curves."""

    def run(batches):
        rng = np.random.default_rng(seed)
        directions = [(rng.standard_normal((dims, DIMS)), rng.random(DIMS)) for _ in range(ORDERINGS)]
        for b in batches:
            x = unit(_matrix(b.column(1)))
            for c, (d, shift) in enumerate(directions):
                place = np.clip((x @ d) / 6 + 0.5, 0, 1) * (2**BITS_EACH - 2) + shift
                key = hilbert_index(place.astype(np.int64), BITS_EACH)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(key), *b.columns], ["curve", "key", "id", "v", "asks"])

    keyed = rows.mapInArrow(run, "curve int, key long, id long, v array<double>, asks boolean")
    return keyed.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")


def window_candidates(along: DataFrame, k: int, window: int = WINDOW) -> DataFrame:
    """Best k of the rows at most `window` places away from each query, by ordering; only neighbouring blocks are in memory."""

    def run(batches):
        curve, ids, rows, asks = None, np.zeros(0, np.int64), None, np.zeros(0, bool)
        done = 0  # rows of the carried block that were queries already

        def answer(upto: int):
            at = np.flatnonzero(asks[done:upto]) + done
            out = []
            for i in at:
                lo, hi = max(0, i - window), min(len(ids), i + window + 1)
                out.append(_pairs(ids[i : i + 1], rows[i : i + 1], ids[lo:hi], rows[lo:hi], np.full(1, -2.0), k))
            if out:
                yield _found(*map(np.concatenate, zip(*out)))

        for b in batches:
            c, new = b.column(0).to_numpy(), _matrix(b.column(3))
            for value in np.unique(c):
                on = c == value
                if value != curve:
                    if rows is not None:
                        yield from answer(len(ids))
                    curve, ids, rows, asks, done = value, np.zeros(0, np.int64), np.zeros((0, new.shape[1])), np.zeros(0, bool), 0
                ids = np.r_[ids, b.column(2).to_numpy()[on]]
                asks = np.r_[asks, b.column(4).to_numpy(zero_copy_only=False)[on]]
                rows = np.vstack([rows, new[on]])
                upto = max(done, len(ids) - window)
                yield from answer(upto)
                cut = max(0, upto - window)
                ids, rows, asks, done = ids[cut:], rows[cut:], asks[cut:], upto - cut
        if rows is not None:
            yield from answer(len(ids))

    return along.mapInArrow(run, FOUND)


def _cap(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Direction and angular radius of the cap that holds the unit rows."""
    mean = x.sum(0)
    size = np.sqrt((mean * mean).sum())
    mean = mean / size if size > 1e-9 else x[0]
    return mean, float(np.arccos(np.clip((x @ mean).min(), -1, 1)))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most `size` rows (id, v, floor) in the order they come in: block, ids, x, floors, cap, radius, least floor."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                ids, x, floor = part.column(0).to_numpy(), _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                mean, radius = _cap(unit(x))
                columns = [pa.array([number], pa.int64()), *[pa.array([y.tobytes()], pa.binary()) for y in (ids, x, floor)], pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([float(floor.min())])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "x", "floors", "cap", "radius", "floor"])
                number += 1

    return materialize(rows.select("id", "v", "floor").mapInArrow(run, "block long, ids binary, x binary, floors binary, cap array<double>, radius double, floor double"), name)


def _complete(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (id, v), in blocks, against queries (query_id, v, floor, key), in blocks: what reaches the floor, k of a block at most."""
    blocks = _packed(rows.select("id", "v", F.lit(0.0).alias("floor")), ROW_BLOCK, "row_blocks")
    along = queries.repartitionByRange("key", "query_id").sortWithinPartitions("key", "query_id")
    asked = _packed(along.select(F.col("query_id").alias("id"), "v", "floor"), QUERY_BLOCK, "query_blocks")
    # The stated queries, in blocks, against all rows, in blocks: caps only, a row for each block.
    a = blocks.select("block", F.col("cap").alias("c"), F.col("radius").alias("r"))
    b = asked.select(F.col("block").alias("chunk"), "cap", "radius", "floor")
    cosine = F.aggregate(F.zip_with("c", "cap", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("r") - F.col("radius")
    reach = F.when(angle <= 0, 1.0).otherwise(F.cos(F.least(angle, F.lit(np.pi))))
    copies = max(1, -(-blocks.count() // FAN))
    pairs = a.join(b, reach >= F.col("floor") - 1e-7).select("block", "chunk", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy"))
    sent = asked.select(F.col("block").alias("chunk"), F.col("ids").alias("q_ids"), F.col("x").alias("q"), "floors", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    faced = pairs.join(sent, ["chunk", "copy"]).join(blocks.select("block", "ids", "x"), "block").select("ids", "x", "q_ids", "q", "floors")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, q_ids, q, floor = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in enumerate((np.int64, np.float64, np.int64, np.float64, np.float64)))
                x, q = x.reshape(len(ids), -1), q.reshape(len(q_ids), -1)
                mean, radius = _cap(unit(x))
                bound = np.cos(np.maximum(0.0, np.arccos(np.clip(unit(q) @ mean, -1, 1)) - radius))
                on = np.flatnonzero(bound >= floor - 1e-7)
                for lo in range(0, len(on), 512):
                    some = on[lo : lo + 512]
                    yield _found(*_pairs(q_ids[some], q[some], ids, x, floor[some], k))

    return faced.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which `asks` holds, by cosine, ties to the smaller id.

    Vectors that are null, zero, hold null or non-finite components, or have another length than most take no part, nor do
    null ids; equal rows count once. With exact=False only the windows are read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asks.alias("asks")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    dims = sizes["n"] if sizes else 1
    rows = rows.where(F.size("v") == dims).withColumn("asks", F.coalesce("asks", F.lit(False))).distinct()
    along = materialize(ordered(rows, dims), "curves")
    near = materialize(_merge(window_candidates(along, k), k), "windows")
    if not exact:
        return near.select("query_id", "rank", "vec_id", "score")
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor"))
    first = along.where("curve = 0")
    queries = first.where("asks").select(F.col("id").alias("query_id"), "v", "key").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    everything = near.select("query_id", "vec_id", "score").unionByName(_complete(first, queries, k))
    return _merge(everything, k).select("query_id", "rank", "vec_id", "score")


def op5_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    """Contract query: embeddings; queries are the rows whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
