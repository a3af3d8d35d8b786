"""Near copies by similarity: minima of word shingles as candidates, each link verified by the shingle sets themselves.

Texts are compared by the Jaccard similarity of their sets of `words`-word shingles, in lower case (A-Z). Of every distinct text
`bands` keys are indexed, each over the least values of `rows` hash functions; texts that share a key are candidates, and two
of similarity s do with probability 1 - (1 - s**rows)**bands: 0.99997 at 0.8 with the defaults. Candidates become links only if
their sets reach the similarity, so a wrong candidate costs time and no document. Groups of near copies are not spelt out in pairs:
a leader of each bucket is compared with its members first, and only what stays apart is indexed by narrower bands and compared pair
by pair (see roots); there two texts of exactly 0.8 meet with probability 0.9992, those of 0.82 with 0.99997.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Rolling, encode, materialize, mix, passing
from .components import components
from .substring import _Words

CHUNK = 512

#: Bands of the second index, and bits of the sketches that go with it.
NARROW, SKETCH = 250, 512


def shingles(parts: list[bytes], words: int, known: _Words, rolling: Rolling) -> np.ndarray:
    """Distinct hashes of the shingles of one text; a text of fewer words is one shingle, one without words has none."""
    if not parts:
        return np.zeros(0, np.uint64)
    width = min(words, len(parts))
    sums = rolling.sums(known.hashes(parts))
    at = np.arange(len(parts) - width + 1)
    return np.unique(mix(rolling.between(sums, at, at + width) + np.uint64(width)))


def _least(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Least value of every 32-bit hash function over the shingles, in one buffer: these are candidates only."""
    out, high = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    held = np.empty((len(factors), min(CHUNK, len(high))), np.uint32)
    for at in range(0, len(high), CHUNK):
        part = high[None, at : at + CHUNK]
        values = np.multiply(factors[:, None], part, out=held[:, : part.shape[1]])
        np.add(values, shifts[:, None], out=values)
        np.minimum(out, values.min(1), out=out)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, text): rows of one id are told apart by their text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))


def sketches(frame: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, row_key, key, size, bands array<long>) of rows (id, row_key, text); key is the hash of the words in lower case."""

    def run(batches):
        rng = np.random.default_rng(42)
        factors = rng.integers(0, 2**32, bands * rows, np.uint32) | np.uint32(1)
        shifts = rng.integers(0, 2**32, bands * rows, np.uint32)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        weight = mix(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
        known, rolling = _Words(), Rolling()
        for b in batches:
            keys, sizes, found = [], [], []
            for text in b.column(2).to_pylist():
                parts = encode(text).lower().split()
                grams = shingles(parts, words, known, rolling)
                keys.append(xxhash.xxh3_64_intdigest(b" ".join(parts)))
                sizes.append(len(grams))
                found.append(mix((_least(grams, factors, shifts).reshape(bands, rows) * weight).sum(1, dtype=np.uint64) ^ salt))
            values = pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands), values)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists], ["id", "row_key", "key", "size", "bands"])

    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, row_key long, key long, size int, bands array<long>")


def _sets(texts: DataFrame, words: int, values: int = 1_000_000) -> DataFrame:
    """(key, grams array<long>) of rows (key, text), in batches of about `values` shingles."""

    def batch(keys, sets):
        offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["key", "grams"])

    def run(batches):
        known, rolling = _Words(), Rolling()
        for b in batches:
            keys, sets, held = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(key)
                sets.append(shingles(encode(text).lower().split(), words, known, rolling))
                held += len(sets[-1])
                if held >= values:
                    yield batch(keys, sets)
                    keys, sets, held = [], [], 0
            if keys:
                yield batch(keys, sets)

    return texts.mapInArrow(run, "key long, grams array<long>")


def most_unlike(similarity: float) -> int:
    """Bits of two sketches that may differ: a bit of texts of the similarity does with probability (1 - similarity) / 2; five deviations more are allowed."""
    p = (1 - similarity) / 2
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def narrow(frame: DataFrame, similarity: float) -> DataFrame:
    """(key, size, root, slot, s0, s1, ...) of rows (key, grams, size, root): a row for each of NARROW bands, with a sketch of SKETCH bits.

    The values in a band are as many as leave two texts of the similarity apart in all bands with probability 0.001 at most (16 values at 0.8,
    where texts of 0.6 share a band of 250 with probability 0.07 and those of 0.4 hardly ever).
    """
    rows = 1
    while rows < 64 and (1 - similarity ** (rows + 1)) ** NARROW <= 0.001:
        rows += 1
    words = SKETCH // 64

    def run(batches):
        rng = np.random.default_rng(43)
        factors = rng.integers(0, 2**32, NARROW * rows, np.uint32) | np.uint32(1)
        shifts = rng.integers(0, 2**32, NARROW * rows, np.uint32)
        salt = mix(np.arange(1001, 1001 + NARROW, dtype=np.uint64))
        weight = mix(np.arange(501, 501 + rows, dtype=np.uint64)) | np.uint64(1)
        at = np.arange(SKETCH) % (NARROW * rows)
        own = mix(np.arange(2001, 2001 + SKETCH, dtype=np.uint64))
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                offsets, flat = part.column(1).offsets.to_numpy(), part.column(1).values.to_numpy().view(np.uint64)
                slots, bits = [], []
                for low, high in zip(offsets, offsets[1:]):
                    least = _least(flat[low:high], factors, shifts)
                    slots.append(mix((least.reshape(NARROW, rows) * weight).sum(1, dtype=np.uint64) ^ salt))
                    bits.append(np.packbits((mix(least[at] ^ own) >> np.uint64(63)).astype(np.uint8)).view(np.int64))
                of = np.repeat(np.arange(part.num_rows), NARROW)
                kept = [part.column(i).take(pa.array(of)) for i in (0, 2, 3)]
                sketch = np.stack(bits)[of]
                columns = [*kept, pa.array(np.concatenate(slots).view(np.int64)), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(words))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "size", "root", "slot", *(f"s{i}" for i in range(words))])

    names = ", ".join(f"s{i} long" for i in range(words))
    return frame.select("key", "grams", "size", "root").mapInArrow(run, f"key long, size int, root long, slot long, {names}")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) of keys whose shingle sets have the similarity."""
    sided = pairs.join(sets.select(F.col("key").alias("u"), F.col("grams").alias("x")), "u").join(sets.select(F.col("key").alias("v"), F.col("grams").alias("y")), "v")
    both = sided.select("u", "v", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.where(F.col("shared") >= similarity * (F.col("total") - F.col("shared")) - 1e-9).select("u", "v")


def roots(frame: DataFrame, classes: DataFrame, words: int, similarity: float, rounds: int = 3) -> DataFrame:
    """(key, root) of distinct texts: root is one for all that links of the similarity connect; texts without any link may be left out.

    Keys that share a band form a bucket. Not all pairs of a bucket are compared: in each round one key of every bucket, picked by a hash, leads,
    and the others that are not yet connected to it are compared with it. Groups of copies so come together at the cost of a row a member. Texts
    that meet others of different components in a bucket after `rounds` rounds are indexed anew by narrow bands, which texts far below
    the similarity do not share, and compared pair by pair.
    """
    index = materialize(classes.where("size > 0").select("key", "size", F.explode("bands").alias("slot")), "bands")
    shared = index.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot")
    met = materialize(index.join(shared, "slot"), "buckets")
    wanted = classes.join(met.select("key").distinct(), "key").select("key", F.col("least.id").alias("w_id"), F.col("least.row_key").alias("w_row"))
    texts = frame.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("row_key") == F.col("w_row"))).select("key", "text")
    sets = materialize(_sets(texts, words).dropDuplicates(["key"]), "sets")
    found, compared, known = None, None, None
    alike = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    for turn in range(rounds + 1):
        here = met.withColumn("root", F.col("key")) if known is None else met.join(known, "key", "left").withColumn("root", F.coalesce("root", "key"))
        lead = F.min(F.struct(F.xxhash64("key", "slot", F.lit(turn)).alias("h"), "key", "size", "root")).alias("l")
        open_ = here.groupBy("slot").agg(lead, F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("slot", "l")
        if turn < rounds:
            apart = here.join(open_, "slot").where((F.col("root") != F.col("l.root")) & alike(F.col("size"), F.col("l.size")))
            pairs = apart.select(F.least("key", "l.key").alias("u"), F.greatest("key", "l.key").alias("v"))
        else:
            rest = here.join(open_.select("slot"), "slot", "left_semi").select("key", "size", "root").distinct()
            fine = materialize(narrow(sets.join(rest, "key"), similarity), "narrow")
            x, y = fine.alias("x"), fine.alias("y")
            unlike = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH // 64)), F.lit(0))
            apart = (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & alike(F.col("x.size"), F.col("y.size"))
            met_again = x.join(y, (F.col("x.slot") == F.col("y.slot")) & apart & (unlike <= most_unlike(similarity)))
            pairs = met_again.select(F.col("x.key").alias("u"), F.col("y.key").alias("v"))
        pairs = pairs.distinct() if compared is None else pairs.distinct().join(compared, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "candidates")
        if pairs.isEmpty():
            if turn < rounds:
                continue
            break
        new = materialize(_verified(pairs, sets, similarity), "links")
        compared = pairs if compared is None else compared.unionByName(pairs)
        found = new if found is None else found.unionByName(new)
        known = materialize(components(found), "roots").withColumnsRenamed({"node": "key"})
    if known is None:
        return classes.select("key", F.col("key").alias("root")).limit(0)
    return known


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 4, labels: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents with one row kept of each group: the one of least id. A group is what links of the similarity connect;
    texts equal but for case and white space are in one group, and so are all texts without words. `labels` may link more: of the
    rows (place, text) it gives (place, label), and rows of one label are linked as well. What is written on the way goes before this returns."""
    frame = _rows(docs, id_col, text_col)
    with passing() as kept:
        drawn = materialize(sketches(frame, words, bands, rows), "sketches")
        order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")
        classes = materialize(drawn.groupBy("key").agg(F.min(order).alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")), "classes")
        rooted = classes.join(roots(frame, classes, words, similarity), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "least")
        if labels is not None:
            place = F.struct("id", "row_key").alias("place")
            told = labels(frame.select(place, "text"))
            known = drawn.select(place, "key").join(rooted.select("key", "root"), "key").join(told, "place").select("root", "label").distinct()
            # Each label's roots as a star around the least of them.
            known = materialize(known, "labels")
            star = known.join(known.groupBy("label").agg(F.min("root").alias("hub")), "label").where("root != hub").select(F.col("root").alias("u"), F.col("hub").alias("v"))
            joined = components(star).select(F.col("node").alias("root"), F.col("root").alias("joined"))
            rooted = rooted.join(joined, "root", "left").select("key", F.coalesce("joined", "root").alias("root"), "least")
        heads = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("__id"), F.col("least.row_key").alias("__row"))
        heads = materialize(heads, "heads")
        copies = drawn.groupBy("id", "row_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("__id"), F.col("row_key").alias("__row"))
        copies = materialize(copies, "copies")
        kept += [heads, copies]
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__row"))
    if copies.isEmpty():
        return docs.join(heads, same, "left_semi")
    # Rows that are equal in id and text: one of each stays, and only they are moved.
    match = heads["__id"].eqNullSafe(copies["__id"]) & (heads["__row"] == copies["__row"])
    single, several = heads.join(copies, match, "left_anti"), heads.join(copies, match, "left_semi")
    once = docs.join(several, same).dropDuplicates(["__id", "__row"]).drop("__id", "__row")
    return docs.join(single, same, "left_semi").unionByName(once)
