"""Substring deduplication by seed and extend.

Seeds: of every run of `length` words the least hash of its `SEED`-word grams is the anchor (winnowing), so equal runs have
equal anchors. Neighbouring runs with one anchor form a stretch, which is all the text that this seed can match. Seeds that
stand in one document only go no further.

Extension, both ways at once and without pairs: the stretch as a whole is looked up by content; where an earlier document
has the same stretch, all of it repeats. Stretches that differ from the others around the same seed, at the edges of a
repeat, are extended run by run, again by content: a run repeats if its content stands in an earlier document. Both look-ups
are a minimum over equal keys and a join with that table of minima, so a passage in a third of all documents costs a row a
document, not a row a pair. Touching runs are merged to maximal repeats, and these are cut from the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Rolling, discard, encode, materialize, mix

SEED = 8


class _Words:
    """Word hashes, kept between texts up to a bound."""

    def __init__(self, keep: int = 300_000) -> None:
        self.known, self.keep = {}, keep

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def stretches(hashes: np.ndarray, rolling: Rolling, length: int):
    """(anchor, content, first run, number of runs) of the stretches of one text of at least `length` words, and its prefix sums."""
    n = len(hashes)
    sums = rolling.sums(hashes)
    grams = mix((sums[SEED:] - sums[:-SEED]) * rolling.inverse[: n - SEED + 1])
    anchor = _least(grams, length - SEED + 1)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    content = mix(rolling.between(sums, first, first + count + length - 1) ^ (count.astype(np.uint64) << np.uint64(40)))
    return anchor[first], content, first, count, sums


def _seeds(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        words, rolling = _Words(), Rolling()
        for b in batches:
            ids, row_keys, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            found, rows = [], []
            for i, text in enumerate(texts):
                parts = encode(text).split()
                if len(parts) >= length:
                    a, c, first, count, _ = stretches(words.hashes(parts), rolling, length)
                    found.append((a, c, first, count))
                    rows.append(np.full(len(a), i))
            if found:
                a, c, first, count = (np.concatenate(x) for x in zip(*found))
                at = pa.array(np.concatenate(rows))
                columns = [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), ids.take(at), row_keys.take(at), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "id", "row_key", "first", "runs"])

    return docs.mapInArrow(run, f"anchor long, content long, id {docs.schema['id'].dataType.simpleString()}, row_key long, first int, runs int")


def _contested_runs(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, id, row_key, at array<int>) of the runs of the wanted stretches: one row for all places of a content in a document, so that a
    few words repeated on and on cost no more than once; wanted: id, row_key, stretches array<struct<anchor, first, runs>>."""
    joined = docs.join(wanted, ["id", "row_key"]).select("id", "row_key", "text", "stretches")

    def run(batches):
        words, rolling = _Words(), Rolling()
        for b in batches:
            for i, (text, wants) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                hashes = words.hashes(encode(text).split())
                sums = rolling.sums(hashes)
                at = np.concatenate([np.arange(w["first"], w["first"] + w["runs"]) for w in wants])
                anchor = np.concatenate([np.full(w["runs"], w["anchor"], np.int64) for w in wants])
                key = mix(rolling.between(sums, at, at + length) + mix(anchor.view(np.uint64)))
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order].astype(np.int32)
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                places = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)].astype(np.int32)), pa.array(at))
                row = pa.array(np.full(len(new), i))
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), b.column(0).take(row), b.column(1).take(row), places], ["key", "id", "row_key", "at"])

    return joined.mapInArrow(run, f"key long, id {docs.schema['id'].dataType.simpleString()}, row_key long, at array<int>")


def repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, repeats array<struct<first, runs>>) of documents with runs of `length` words that stand in a document of smaller id.

    `first` counts words from 0, `runs` neighbouring runs start there. Rows with a null id neither repeat nor are repeated;
    rows that share an id count as one document, but each has the spans of its own text: row_key is the text's xxhash64.
    """
    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text")).where("id is not null")
    seeds = materialize(_seeds(frame, length), "seeds")
    # Look up whole stretches: the first document of each content, and of each anchor.
    contents = seeds.groupBy("anchor", "content").agg(F.min("id").alias("source"))
    anchors = contents.groupBy("anchor").agg(F.min("source").alias("least"), F.count("*").alias("contents"))
    rival = contents.join(anchors.where("contents > 1"), "anchor", "left").select("anchor", "content", "source", "least")
    rival = rival.where("least is not null")
    judged = materialize(
        seeds.alias("s").join(contents.alias("c"), ["anchor", "content"]).where("s.id > c.source").select("s.id", "s.row_key", F.struct("s.first", "s.runs").alias("span")), "whole"
    )
    # At the edges: the first document of each content that shares its anchor with other contents.
    edge = seeds.join(rival, ["anchor", "content"]).where("id = source")
    wanted = edge.groupBy("id", "row_key").agg(F.collect_list(F.struct("anchor", "first", "runs")).alias("stretches"))
    runs = materialize(_contested_runs(frame, wanted, length), "runs")
    sources = runs.groupBy("key").agg(F.min("id").alias("source"), F.max("id").alias("last")).where("source < last").select("key", "source")
    late = runs.join(sources, "key").where("id > source").select("id", "row_key", F.explode("at").alias("first"))
    late = late.select("id", "row_key", F.struct("first", F.lit(1).alias("runs")).alias("span"))
    # A copy of an edge stretch in a later document is judged whole above, for its first document has the smaller id.
    return judged.unionByName(late).groupBy("id", "row_key").agg(F.collect_list("span").alias("repeats")).withColumnRenamed("id", id_col)


def covered(n_words: int, spans: list[dict] | None, length: int) -> np.ndarray:
    """Which words the repeats cover: maximal repeats are the True runs."""
    edge = np.zeros(n_words + 1, np.int64)
    if spans:
        first = np.fromiter((s["first"] for s in spans), np.int64, len(spans))
        last = first + np.fromiter((s["runs"] for s in spans), np.int64, len(spans)) + length - 1
        np.add.at(edge, np.minimum(first, n_words), 1)
        np.add.at(edge, np.minimum(last, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _with_repeats(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    found = repeats(docs, length, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("row_key").alias("__row"), F.col("repeats").alias("__repeats"))
    return docs.join(found, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__row")), "left").drop("__id", "__row")


def cut(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the words of repeats; the white space between kept neighbours stays as it is.

    A document that is all repeats keeps its row with an empty text.
    """
    joined = _with_repeats(docs, length, id_col, text_col)
    place = joined.columns.index(text_col)
    names = [c for c in joined.columns if c != "__repeats"]

    def run(batches):
        import re

        word = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
        for b in batches:
            texts = b.column(place).to_pylist()
            for i, spans in enumerate(b.column(len(names)).to_pylist()):
                if spans:
                    parts = word.findall(encode(texts[i]))
                    gone = covered(len(parts), spans, length)
                    texts[i] = b"".join(p for p, g in zip(parts, gone) if not g).decode("utf-8", "surrogatepass")
            columns = [b.column(k) for k in range(len(names))]
            columns[place] = pa.array(texts, b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    joined = _with_repeats(docs.select(id_col, text_col), length, id_col, text_col)

    def run(batches):
        for b in batches:
            total, removed, sha = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = encode(text).split()
                total.append(len(parts))
                if spans:
                    gone = covered(len(parts), spans, length)
                    parts = [p for p, g in zip(parts, gone) if not g]
                removed.append(total[-1] - len(parts))
                sha.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def op9_seed_extend_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: documents, runs of 50 words."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
