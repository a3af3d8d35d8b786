"""Best-fit packing by exact-complement hashing.

Only lengths matter, and there are `capacity` of them at most: Spark counts the pieces of each length, and the plan is made
on that histogram, whose size is fixed by the capacity and not by the data. From the longest length down, the gap of a
sequence is looked up among the single, pair and triple sums of lengths that are still there; a combination that fills it
exactly is used as often as its counts allow, all at once. What finds no exact complement is filled best-fit: again and
again with the longest length that fits. The plan is a list of patterns with multiplicities; pieces take their places by
their rank among those of equal length, which a two-level count over hash buckets gives without gathering a length in one task.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

CAPACITY, END_ID = 1024, 2
#: About how many pieces of one length are ranked in one group.
BUCKET_ROWS = 20_000


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, longest first) with how many sequences have them; counts[n]: pieces of length n.

    Triples may use up short pieces that many long ones need; so a plan with them is held against one without, and the fewer
    sequences win.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(counts: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with exact complements of up to `most` pieces."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> bool:
        need = np.bincount(pattern, minlength=len(left))
        on = need > 0
        times = int((left[on] // need[on]).min())
        if times > 0:
            left[:] -= times * need
            out.append((pattern, times))
        return times > 0

    def exact(n: int) -> tuple[int, ...] | None:
        gap = capacity - n
        there = np.flatnonzero(left[: gap + 1])
        if n == gap and left[n] < 2:
            there = there[there != n]
        if gap and left[gap] and (gap != n or left[n] > 1):
            return (n, gap)
        if most < 2:
            return None
        have = left.copy()
        have[n] -= 1
        there = np.flatnonzero(have[: gap + 1])
        a = there[::-1]
        b = gap - a
        ok = (b > 0) & (b <= a) & (have[b] > (a == b))
        if ok.any():
            k = int(np.argmax(ok))
            return (n, int(a[k]), int(b[k]))
        if most < 3:
            return None
        for x in there[::-1]:
            rest = gap - int(x)
            if rest < 2:
                continue
            if 3 * x < gap:
                break
            have[x] -= 1
            y = there[(there <= x) & (there < rest)][::-1]
            z = rest - y
            ok = (z > 0) & (z <= y) & (have[y] > 0) & (have[z] > (y == z))
            have[x] += 1
            if ok.any():
                k = int(np.argmax(ok))
                return (n, int(x), int(y[k]), int(z[k]))
        return None

    if left[capacity]:
        use((capacity,))
    for n in range(capacity - 1, 0, -1):
        while left[n] and (found := exact(n)):
            use(found)
    while left.any():
        have, pattern, gap = left.copy(), [], capacity
        while len(fits := np.flatnonzero(have[: gap + 1])):
            n = int(fits[-1])
            pattern.append(n)
            have[n] -= 1
            gap -= n
        use(tuple(pattern))
    return out


_TOKENIZERS: dict = {}
#: What the pre-tokenizer may take for white space; every run of it starts a new chunk of a text.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks before which a word ends: the pre-tokenizer never makes a token of a letter or digit and one of these.
MARKS = ".,;:!?"
#: Letters and digits of which any version of Unicode says so.
WORD_CHARS = r"A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u024f"
CHUNK = re.compile(f"[{SPACES}]*+(?:[{WORD_CHARS}]++(?:(?=[{MARKS}])|[^{SPACES}]*+)|[^{SPACES}]++)|[{SPACES}]++")
#: Chunks of which one string is made to encode them.
JOINED = 256


class _Tokenizer:
    """Token ids of whole texts by the tokenizers library, as bytes of little-endian unsigned 32-bit numbers.

    A byte-level pre-tokenizer never makes a token of something and white space behind it, nor of a word and a mark behind it, so the
    ids of a text are those of its chunks: white space and what follows up to the next one, without a word's marks, which are a chunk
    with what is behind them. The ids of short chunks are kept up to a bound, since words repeat, and tokenizers encodes what is new of
    a batch at once: in strings of many chunks where each begins with white space, whose ids are told apart by the bytes that they stand
    for. With another pre-tokenizer, or one that sees more than a chunk, whole texts are encoded. Strings of special tokens are read as
    that file has it.
    """

    def __init__(self, path: str, keep: int = 800_000, longest: int = 48) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        special = [t for t in spec.get("added_tokens") or [] if t["lstrip"] or t["rstrip"] or t["single_word"] or CHUNK.fullmatch(t["content"]) is None or t["content"][:1].isspace() or set(MARKS) & set(t["content"])]
        self.by_chunk = plain and not special and not spec.get("truncation") and not spec.get("padding")
        self.model, self.known, self.keep, self.longest, self.lengths = Tokenizer.from_file(path), {}, keep, longest, None

    def _ids(self, texts: list[str]) -> list[bytes]:
        ids = [array("I", e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for a in ids:
                a.byteswap()
        return [a.tobytes() for a in ids]

    def _lengths(self) -> np.ndarray:
        """How many bytes each id stands for: a byte-level token has a character for each of its bytes, an added one is written as it is."""
        if self.lengths is None:
            vocabulary, added = self.model.get_vocab(with_added_tokens=True), self.model.get_added_tokens_decoder()
            self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.lengths[i] = len(token.encode()) if i in added else len(token)
        return self.lengths

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk."""
        joint = [c for c in chunks if c[0].isspace() and not c[-1].isspace()]
        found: dict[str, bytes] = {}
        groups = [joint[i : i + JOINED] for i in range(0, len(joint), JOINED)]
        lengths = self._lengths()
        for group, ids in zip(groups, self._ids(["".join(g) for g in groups])):
            ends = np.cumsum(lengths[np.frombuffer(ids, "<u4")])
            want = np.cumsum([len(c.encode()) for c in group])
            at = np.searchsorted(ends, want)
            # Where the ids do not part as the chunks do, the chunks are encoded one by one.
            if at[-1] == len(ends) - 1 and (ends[at] == want).all():
                cuts = [0, *(4 * (at + 1)).tolist()]
                found.update(zip(group, (ids[x:y] for x, y in zip(cuts, cuts[1:]))))
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._ids(rest)))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_chunk:
            return self._ids([t or "" for t in texts])
        parts = [CHUNK.findall(t) if t else [] for t in texts]
        known = self.known
        now = self._new(list(set().union(*parts).difference(known)))
        room = max(0, self.keep - len(known))
        stays = set(islice((c for c in now if len(c) <= self.longest), room)) if room < len(now) else None
        known.update(now)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        # What there is no room for goes again.
        for c in now:
            if len(c) > self.longest or (stays is not None and c not in stays):
                del known[c]
        return out


def _batches(texts: list[str | None], rows: int = 1000, chars: int = 4_000_000):
    """Places (from, to) of groups of texts, bounded in rows and, but for single texts, in characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (i - start >= rows or held + n > chars):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids array<int>]): every document's ids and `end_id`, cut where longer than `capacity`.

    The cut is from the end, so the first piece is the shorter one. Null and empty texts are just `end_id`.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        model = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, _Tokenizer(tokenizer))
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _batches(texts):
                rows = []
                for i, ids in enumerate(model.encode(texts[lo:hi]), lo):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * a : 4 * z]
                        rows.append((i, k, a, z - a, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
                if rows:
                    at, k, a, n, crc, ids = zip(*rows)
                    columns = [b.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.array(ids, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank on, which first sequence, which offset. Its size follows from the plan, not from the data."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            found.setdefault(n, []).append((used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*v)) for n, v in found.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a frame with a column length (1 to capacity). Pieces are ranked by number of their row in the
    written table, so those that agree in all columns spread like any others; they may swap places."""
    keys = [c for c in parts.columns if c != "ids"]
    stored = materialize(parts.withColumn("__salt", F.monotonically_increasing_id()), "pieces")
    # `capacity` rows at most, whatever the data hold.
    histogram = np.zeros(capacity + 1, np.int64)
    for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    buckets = max(16, -(-int(histogram.max()) // bucket_rows))
    ranked = stored.withColumn("__h", F.xxhash64("__salt", *keys)).withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("long"))
    counts = ranked.groupBy("length", "__b").agg(F.count("*").alias("n"))
    table = places(plan(histogram, capacity))
    before = counts.withColumn("__before", F.sum("n").over(W.partitionBy("length").orderBy("__b")) - F.col("n")).drop("n")
    inside = F.row_number().over(W.partitionBy("length", "__b").orderBy("__h", "__salt")) - 1
    ordered = ranked.withColumn("__r", inside).join(before, ["length", "__b"]).withColumn("__rank", F.col("__before") + F.col("__r"))
    frame = ordered.select(*parts.columns, "__rank")
    at, names = parts.columns.index("length"), [*parts.columns, "sequence_id", "offset"]
    shared = parts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            lengths, rank = b.column(at).to_numpy(), b.column(len(names) - 2).to_numpy()
            sequence, offset = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                since, base, start = shared.value[int(n)]
                k = np.searchsorted(since, rank[rows], "right") - 1
                sequence[rows] = base[k] + rank[rows] - since[k]
                offset[rows] = start[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names)

    schema = parts.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return frame.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; sequences hold `capacity` tokens at most. No documents: no rows."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), capacity)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_exact_complement_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: documents in sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
