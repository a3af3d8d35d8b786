"""Language by the nearest of several centroids of normalised TF-IDF vectors of character n-grams.

A text is read in lower case, as words of letters (with their marks) between blanks; its n-grams of one to three characters, those that do
not run over a blank, are counted in `DIMENSIONS` hashed places. A count weighs 1 + its logarithm, times the inverse document frequency,
and vectors have length 1. Document frequencies are counted over all texts that may be learnt from; centroids are fitted on at most `max_docs`
of them for each of the `max_langs` commonest languages, those of least hash, by spherical k-means within each language: a language has as many
centroids as it has ways of writing. A text gets the language of the centroid with the highest cosine.

Rejection is by distance: a centroid knows the cosine that all but `strangers` of its own texts reach, and a text below it, by more than `slack`, is no
text of that language. A text with fewer places than these have needs less: the cosine of a sample of m of M places falls with the root of m / M. The score is the language's share in a softmax over the best cosines of languages.

Null texts and texts without a letter are `und` with score 0, and so are all where nothing can be learnt (no table, no language). Labels, source and id
are no inputs of a prediction. Texts of any length are read whole, in slices. Repeated rows are predicted one by one; in the sample a text counts
once. Ties go to the language, then the centroid, that comes first in order. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, mix
from .toxicity import trainable

DIMENSIONS, LONGEST = 8192, 3
#: Characters and texts that are counted at once.
SLICE, ROWS = 1 << 20, 128
TEMPERATURE = 0.05


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and whether it is one or a mark on one."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    mark = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)
    return letter, letter | mark


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIMENSIONS) counts of n-grams, and whether a text has a letter at all."""
    letter, part = _letters()
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    blank = np.array([32], np.uint32)
    flat = np.concatenate([blank, *[x for p in points for x in (p, blank)], blank, blank])
    row = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in points])
    out = np.zeros(len(texts) * DIMENSIONS)
    has = np.zeros(len(texts), bool)
    for start in range(0, len(row), SLICE):
        size = min(SLICE, len(row) - start)
        # One place before and LONGEST - 1 behind, so that slices share no n-gram and lose none.
        window = flat[start : start + size + LONGEST]
        inside = part[window]
        has[row[start : start + size][letter[window[1 : size + 1]]]] = True
        code = np.where(inside, window, 32).astype(np.uint64)
        base = row[start : start + size] * DIMENSIONS
        hashed = np.zeros(size, np.uint64)
        for n in range(1, LONGEST + 1):
            hashed = mix(hashed * np.uint64(31) + code[n - 1 : n - 1 + size] + np.uint64(n))
            # A blank may stand first or last in an n-gram, not between and not alone.
            first, second = inside[:size], inside[1 : 1 + size]
            good = first if n == 1 else first | second if n == 2 else second
            out += np.bincount((base + (hashed % np.uint64(DIMENSIONS)).astype(np.int64))[good], minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS), has


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF rows (zero for texts without a letter), and whether a text has a letter."""
    x, has = counts(texts)
    x = (np.log(np.maximum(x, 1)) + (x > 0)) * idf
    length = np.sqrt((x * x).sum(1))
    x /= np.where(length > 0, length, 1)[:, None]
    x[~has] = 0
    return x, has


@dataclass
class Model:
    """idf by place; centroids as unit rows, each of the language of that number, with the least cosine of its texts and their usual number of
    places."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray
    places: np.ndarray
    langs: list[str] = field(default_factory=list)


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows, from farthest-first seeds: (centroids, number of each row's). Centroids without a row are left out."""
    seeds, near = [0], x @ x[0]
    while len(seeds) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        seeds.append(far)
        near = np.maximum(near, x @ x[far])
    centre, of = x[seeds], None
    for _ in range(rounds):
        now = (x @ centre.T).argmax(1)
        if of is not None and (now == of).all():
            break
        used, of = np.unique(now, return_inverse=True)
        centre = np.stack([x[of == c].sum(0) for c in range(len(used))])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    return centre, (x @ centre.T).argmax(1)


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each place is used, and of how many; only DIMENSIONS sums reach the driver."""

    def run(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            rows = b.column(0).to_pylist()
            for at in range(0, len(rows), ROWS):
                x, has = counts(rows[at : at + ROWS])
                total += (x[has] > 0).sum(0)
                n += int(has.sum())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1], pa.int32()), pa.array(np.r_[total[used], n], pa.int64())], ["place", "n"])

    found = dict(texts.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n")).collect())
    out = np.zeros(DIMENSIONS)
    n = found.pop(-1, 0)
    for place, used in found.items():
        out[place] = used
    return out, n


def train(docs: DataFrame, max_docs: int = 600, max_langs: int = 256, centroids: int = 4, strangers: float = 0.01, slack: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows of `docs`, which the caller has freed of held-out ones. What the driver gets is bounded by max_langs, centroids and DIMENSIONS."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    frequency, n = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang")
    # The least hashes of a language are among the least ones of its shares.
    hashes = rows.select("lang", "h").distinct().withColumn("share", F.pmod("h", F.lit(32)))
    hashes = hashes.withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy("h"))).where(F.col("place") <= max_docs)
    hashes = hashes.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("place") <= max_docs)
    picked = F.broadcast(hashes.join(F.broadcast(common), "lang").select("lang", "h"))  # max_langs * max_docs rows
    sample = rows.join(picked, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    columns = ["lang", "number", "floor", "places", "vector"]

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, has = vectors(group.sort_values("h")["text"].tolist(), idf)
        x = x[has]
        if not len(x):
            return pd.DataFrame([(key[0], -1, 0.0, 0.0, b"")], columns=columns)
        centre, of = cluster(x, centroids)
        near = (x * centre[of]).sum(1)
        return pd.DataFrame([(key[0], c, float(np.quantile(near[of == c], strangers)) - slack, float(np.median((x[of == c] > 0).sum(1))), centre[c].astype(np.float32).tobytes()) for c in np.unique(of)], columns=columns)

    found = sorted(sample.groupBy("lang").applyInPandas(fit, "lang string, number int, floor double, places double, vector binary").where("number >= 0").collect(), key=lambda r: (r["lang"], r["number"]))
    langs = sorted({r["lang"] for r in found})
    table = np.array([np.frombuffer(r["vector"], np.float32) for r in found]).reshape(len(found), DIMENSIONS)
    return Model(idf, table, np.array([langs.index(r["lang"]) for r in found], np.int64), np.array([r["floor"] for r in found]), np.array([r["places"] for r in found]), langs)


def predict(docs: DataFrame, model: Model, reject: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cosine, rejected) of every row; with `reject` a text too far from all centroids is `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_langs * centroids * DIMENSIONS numbers at most

    def run(batches):
        m: Model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), ROWS):
                part = texts[at : at + ROWS]
                lang, score, cosine, far = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part), bool)
                if m.langs:
                    x, has = vectors(part, m.idf)
                    near = x @ m.centroids.T.astype(np.float64)
                    first = near.argmax(1)
                    cosine = np.clip(near[np.arange(len(part)), first], 0, 1)
                    far = has & (cosine < m.floor[first] * np.sqrt(np.minimum(1, (x > 0).sum(1) / m.places[first])))
                    best = np.stack([near[:, m.owner == k].max(1) for k in range(len(m.langs))], axis=1)
                    share = np.exp((best - best.max(1, keepdims=True)) / TEMPERATURE)
                    score = np.where(has, 1 / share.sum(1), 0.0)
                    lang = [m.langs[m.owner[f]] if h and not (reject and r) else "und" for f, h, r in zip(first, has, far)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(lang, pa.string()), pa.array(score), pa.array(cosine), pa.array(far)], ["id", "lang_pred", "score", "cosine", "rejected"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, lang_pred string, score double, cosine double, rejected boolean").withColumnRenamed("id", id_col)


def op12_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's language, learnt from rows that are not held out. Every text with a letter gets a learnt
    language here; `rejected` says which ones lie too far from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(trainable(F.col("doc_id"))))
    return predict(docs, model, reject=False).select("doc_id", (~trainable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "cosine", "rejected")
