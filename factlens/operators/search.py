"""Lexical, semantic and hybrid search for tables of queries.

Lexical matching is by literal substring, as the score is defined on it; an inverted index of grams finds what may match. Nearest vectors are found exactly
by blocks, or approximately by an index of sign sketches with exact reranking. Units are never broadcast. Ranking is always over all matches, paging comes last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..schemas import UNIT_TYPES
from .text import SLOTS, frequent_filter, may_be_frequent
from .windows import page

# Weights of the lexical score.
PHRASE, ALL_KEYWORDS, HIT, HITS, PREFIX, RANK = 40, 15, 6, 3, 10, 10
UNIT_BONUS = {"record": 3, "page": 2, "validation": 1}
LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.6, 0.4


def prepare(queries: DataFrame, text_col: str = "text", max_chars: int | None = None, max_terms: int | None = None) -> DataFrame:
    """Adds phrases (what is quoted) and keywords (the other words) to a table of query texts, of all of it unless bounds are given."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    text = F.substring(text, 1, max_chars) if max_chars else text
    phrases = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'"([^"]*)"?'), 1), lambda p: F.trim(p)), lambda p: p != "")
    words = F.filter(F.split(F.regexp_replace(text, r'"[^"]*"?', " "), " "), lambda w: w != "")
    some = lambda terms: F.slice(terms, 1, max_terms) if max_terms else terms
    return queries.withColumn("phrases", some(phrases)).withColumn("keywords", some(words))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def filter_units(units: DataFrame, page_number: int | None = None, pages: DataFrame | None = None, **equal) -> DataFrame:
    """AND of optional equalities; the page filter is by the page's number."""
    for column, value in equal.items():
        if value is not None:
            units = units.where(F.col(column) == value)
    if page_number is not None and pages is not None:
        units = units.join(pages.where(F.col("page_number") == page_number).select("page_id"), "page_id", "left_semi")
    return units


def _text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """What `of` makes of a value that is computed once: as a column of a projection it would be put in wherever it is named, for each term again."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def text_match(phrases: Column, keywords: Column, text: Column) -> Column:
    """Every phrase and keyword is in the (lower-case) text; a query without any matches nothing."""
    terms = F.concat(phrases, keywords)
    return (F.size(terms) > 0) & F.forall(terms, lambda t: text.contains(F.lower(t)))


def lexical_score(phrases: Column, keywords: Column, tsrank: Column | None = None, text: Column | None = None) -> Column:
    """Score of a unit (title, content, entity, metric, unit_type) for a query; its lower-case text is the column __text where none is given."""
    text = F.col("__text") if text is None else text
    count = lambda terms, test: F.size(F.filter(terms, test))
    hit = count(keywords, lambda k: text.contains(F.lower(k)))
    score = PHRASE * count(phrases, lambda p: text.contains(F.lower(p)))
    score = score + F.when((F.size(keywords) > 0) & (hit == F.size(keywords)), ALL_KEYWORDS).otherwise(0)
    score = score + HIT * F.least(hit, F.lit(HITS))
    for c in ("entity", "metric"):
        begins = F.lower(F.coalesce(F.col(c), F.lit("")))
        score = score + PREFIX * count(keywords, lambda k: (F.length(k) > 0) & begins.startswith(F.lower(k)))
    if tsrank is not None:
        score = score + F.least(F.greatest(tsrank, F.lit(0.0)), F.lit(1.0)) * RANK
    bonus = F.lit(0)
    for kind, n in UNIT_BONUS.items():
        bonus = F.when(F.col("unit_type") == kind, n).otherwise(bonus)
    return (score + bonus).cast("double")


def _unit_order() -> Column:
    out = F.lit(len(UNIT_TYPES))
    for i, kind in enumerate(UNIT_TYPES):
        out = F.when(F.col("unit_type") == kind, i).otherwise(out)
    return out


def lexical(units: DataFrame, phrases: list[str], keywords: list[str], limit: int | None = None, offset: int = 0, total: bool = False) -> DataFrame:
    """Matches of one query with their score, best first; with `total`, a column that says how many there are in all."""
    p, k = (F.array(*map(F.lit, x)).cast("array<string>") for x in (phrases, keywords))
    found = units.withColumn("__text", _text("title", "content")).where(text_match(p, k, F.col("__text")))
    scored = found.withColumn("score", lexical_score(p, k)).drop("__text")
    order = [F.desc("score"), _unit_order(), "document_id", "unit_id"]
    if limit:
        return page(scored, order, limit, offset, total)
    shown = scored.orderBy(*order)
    return shown.crossJoin(found.agg(F.count("*").alias("total"))) if total else shown  # one row


#: Longest grams of the index; a shorter term is one gram.
GRAM = 3
#: Grams of a query that its candidates must hold before texts are read.
ANCHORS = 8
#: Share of the units that tells which grams are rare, where no stored index does.
SAMPLE = 0.05


def _grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The distinct runs of so many characters. Each place of the text begins one; a lookahead reads them in one pass."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes]))


def postings(units: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(gram, unit_id): which units hold which runs of one to three characters, in lower case."""
    return units.select("unit_id", F.explode_outer(_grams(_text("title", "content"), sizes)).alias("gram")).where("gram is not null").select("gram", "unit_id")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(gram, df) of postings."""
    return index.groupBy("gram").agg(F.count("*").alias("df"))


#: Postings and units of a block of the stored index at most.
POSTINGS, UNITS = 1 << 21, 1 << 16
#: Characters of a text that are taken at once.
PIECE = 1 << 20


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _keys(text: str | None) -> np.ndarray:
    """The distinct grams of a text as numbers: 21 bits a character, the first one lowest, 0 behind the last."""
    points, found = _points(text).astype(np.int64) + 1, [np.zeros(0, np.int64)]
    for at in range(0, len(points), PIECE):
        p = points[at : at + PIECE + GRAM - 1]
        found += [np.unique(sum(p[i : len(p) - n + i + 1] << 21 * i for i in range(n))) for n in range(1, GRAM + 1) if len(p) >= n]
    return np.unique(np.concatenate(found))


def _gram(key: int) -> str:
    return "".join(chr((key >> 21 * i & 0x1FFFFF) - 1) for i in range(GRAM) if key >> 21 * i)


def _packed(places: np.ndarray, of: int) -> bytes:
    """Places among `of` units: 2 bytes each or, where that is no longer, a bit for each unit."""
    return places.tobytes() if 2 * len(places) < -(-of // 8) else np.packbits(np.bincount(places, minlength=of).astype(bool)).tobytes()


def _unpacked(packed: bytes, n: int, of: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint16) if 2 * n < -(-of // 8) else np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), count=of)).astype(np.uint16)


def _blocks_of_postings(texts: DataFrame) -> DataFrame:
    """(gram, block, n, of, places, units) of rows (unit_id, text): which of the `of` units of a block hold a gram, `n` of them, by their places; and a row
    without a gram for each block, with its units. Blocks are made of the rows that a task reads, one after the other, so no posting is moved."""
    kind = texts.schema["unit_id"].dataType.simpleString()

    def run(batches):
        task, number, ids, keys, held = TaskContext.get().partitionId(), 0, [], [], 0

        def rows():
            of, count = sum(map(len, ids)), [len(k) for k in keys]
            flat, place = np.concatenate(keys), np.repeat(np.arange(of, dtype=np.uint16), count)
            order = np.argsort(flat, kind="stable")
            flat, place = flat[order], place[order]
            start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
            ends, block, units = np.r_[start[1:], len(flat)].astype(np.int64), (task << 32) + number, pa.concat_arrays(ids)
            yield [None], [of], [None], pa.ListArray.from_arrays(pa.array([0, of], pa.int32()), units), block, of
            for at in range(0, len(start), 8192):
                a, b = start[at : at + 8192], ends[at : at + 8192]
                places = [_packed(place[i:j], of) for i, j in zip(a.tolist(), b.tolist())]
                yield [_gram(k) for k in flat[a].tolist()], b - a, places, pa.nulls(len(a), pa.list_(units.type)), block, of

        def batch(grams, n, places, units, block, of):
            m = len(grams)
            columns = [pa.array(grams, pa.string()), pa.array([block] * m, pa.int64()), pa.array(n, pa.int32()), pa.array([of] * m, pa.int32()), pa.array(places, pa.binary()), units]
            return pa.RecordBatch.from_arrays(columns, ["gram", "block", "n", "of", "places", "units"])

        for b in batches:
            begin = 0
            for i, text in enumerate(b.column(1)):
                keys.append(_keys(text.as_py()))
                held += len(keys[-1])
                if held >= POSTINGS or len(keys) == UNITS or i == b.num_rows - 1:
                    ids.append(b.column(0).slice(begin, i + 1 - begin))
                    begin = i + 1
                if held >= POSTINGS or len(keys) == UNITS:
                    yield from (batch(*r) for r in rows())
                    number, ids, keys, held = number + 1, [], [], 0
        if keys:
            yield from (batch(*r) for r in rows())

    return texts.mapInArrow(run, f"gram string, block long, n int, of int, places binary, units array<{kind}>")


def write_postings(units: DataFrame, path: str, parts: int = 64) -> None:
    """Store the index: blocks of postings by hash of the gram, sorted by it, and the grams' frequencies. Nothing is shuffled but the counts: each task writes
    the postings of the units that it reads, as lists of places, about a byte a posting."""
    blocks = _blocks_of_postings(units.select("unit_id", _text("title", "content").alias("text")))
    blocks = blocks.withColumn("part", F.when(F.col("gram").isNull(), F.lit(-1)).otherwise(F.pmod(F.hash("gram"), F.lit(parts))))
    blocks.sortWithinPartitions("part", "gram").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{path}/postings")
    stored = blocks.sparkSession.read.parquet(f"{path}/postings").where("gram is not null")
    stored.groupBy("gram").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/frequencies")


def read_postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks of postings, frequencies) as write_postings stored them."""
    return spark.read.parquet(f"{path}/postings").drop("part"), spark.read.parquet(f"{path}/frequencies")


def _terms(asked: DataFrame) -> DataFrame:
    """(query_id, term, gram): the grams of each query's terms. Terms shorter than a gram count only where a query has no longer one."""
    terms = F.array_distinct(F.transform(F.concat("phrases", "keywords"), lambda t: F.lower(t)))
    long = F.filter(terms, lambda t: F.length(t) >= GRAM)
    each = asked.select("query_id", F.explode(F.when(F.size(long) > 0, long).otherwise(terms)).alias("term"))
    return each.select("query_id", "term", F.explode(F.when(F.length("term") < GRAM, F.array("term")).otherwise(_grams(F.col("term"), (GRAM,)))).alias("gram"))


def _anchors(rated: DataFrame) -> DataFrame:
    """(query_id, n, gram): the rarest grams of each query, one of each term first, then further ones, of terms (query_id, term, gram, df). A query with a
    gram that no unit holds (df is null) has no match and is left out."""
    each = rated.groupBy("query_id", "term").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"), F.count_if(F.col("df").isNull()).alias("absent"))
    flat = each.select("query_id", "absent", F.posexplode_outer(F.slice("grams", 1, ANCHORS)).alias("place", "at")).groupBy("query_id")
    order = F.array_sort(F.collect_list(F.struct("place", "at.df", "at.gram")))
    chosen = flat.agg(F.sum("absent").alias("absent"), F.slice(F.array_distinct(F.transform(order, lambda x: x["gram"])), 1, ANCHORS).alias("grams")).where("absent = 0")
    return chosen.select("query_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))


def _among(rows: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    """Rows whose column may be among the terms (of a frame with a column `term`), by a hashed filter of fixed size, so that others are not moved."""
    # One row, joined by what is always 0, but no literal: a hash join, where a cross join would be a nested loop.
    slots = frequent_filter(terms.distinct()).withColumn("__one", F.pmod(F.xxhash64(F.size("slots")), F.lit(1).cast("long")))
    met = rows.withColumn("__one", F.pmod(F.xxhash64(column), F.lit(1).cast("long"))).join(F.broadcast(slots), "__one")
    return met.where(may_be_frequent(F.col("slots"), F.col(column))).drop("__one", "slots")


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, unit_id) of units that hold all anchors of a query: the postings of its rarest grams, intersected block by block. Only ids move."""
    kind = anchors.schema["query_id"].dataType.simpleString()
    asked_for = _among(index.where("gram is not null").select("gram", "block", "n", "of", "places"), anchors.select(F.col("gram").alias("term")), "gram")
    held = asked_for.join(anchors.withColumnRenamed("n", "anchors"), "gram").groupBy("query_id", "block").agg(F.collect_list(F.struct("n", "places")).alias("held"), F.first("of").alias("of"), F.first("anchors").alias("anchors"))
    lists = held.where(F.size("held") == F.col("anchors")).select("query_id", "block", "of", "held")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                found = []
                for of, held in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    several = [_unpacked(h["places"], h["n"], of) for h in held]
                    found.append(reduce(lambda a, c: np.intersect1d(a, c, assume_unique=True), several))
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(found).astype(np.int32))], ["query_id", "block", "place"])

    met = lists.mapInArrow(run, f"query_id {kind}, block long, place int")
    # Merged by sort: Spark takes the size of the blocks' rows for that of the units in them and would send all ids to the driver.
    names = index.where("gram is null").select("block", F.posexplode("units").alias("place", "unit_id")).hint("merge")
    return met.join(names, ["block", "place"]).select("query_id", "unit_id")


#: Words of 64 bits of a signature.
WORDS = 16
#: Characters of the runs by which a query meets units, where it has a term so long.
LONG = 6
#: Slots of the hashed counts that tell which runs are rare.
RARE = 1 << 18


def _runs(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many characters."""
    n = max(0, len(points) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _signature(hashes: np.ndarray) -> np.ndarray:
    """WORDS words in which each hash sets one bit: what holds all grams of another has all its bits."""
    bits = np.zeros(64 * WORDS, bool)
    bits[hashes % np.uint64(64 * WORDS)] = True
    return np.packbits(bits).view(np.int64)


def _hashed(text: str | None, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Distinct hashes of the runs of a text, by size."""
    points, out = _points(text).astype(np.uint64), {}
    for n in sizes:
        out[n] = np.unique(np.concatenate([np.unique(_runs(points[at : at + PIECE + n - 1], n)) for at in range(0, max(1, len(points)), PIECE)]))
    return out


def _longs(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WORDS), pa.array(flat))


def _counted(texts: DataFrame) -> np.ndarray:
    """In how many texts (of unit_id, text) a run of GRAM or LONG characters of each slot stands."""

    def run(batches):
        seen = np.zeros(RARE, np.int64)
        for b in batches:
            for text in b.column(1):
                for h in _hashed(text.as_py(), (GRAM, LONG)).values():
                    seen[np.unique(h % np.uint64(RARE)).astype(np.int64)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "n"])

    out = np.zeros(RARE, np.int64)
    for r in texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most RARE rows
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out


def _meeting(asked: DataFrame, seen: np.ndarray) -> DataFrame:
    """(query_id, gram, size, needed): the run, of LONG characters if a term has so many, by which a query meets units, the one that looks rarest; and the
    signature of all its grams."""
    kind = asked.schema["query_id"].dataType.simpleString()
    terms = F.array_distinct(F.transform(F.concat("phrases", "keywords"), lambda t: F.lower(t)))

    def run(batches):
        for b in batches:
            grams, sizes, needed = [], [], []
            for words in b.column(1).to_pylist():
                most = min(GRAM, max(map(len, words)))
                runs = {n: np.unique(np.concatenate([_runs(_points(w).astype(np.uint64), n) for w in words])) for n in (most, LONG)}
                size = LONG if len(runs[LONG]) else most
                h = runs[size]
                rare = np.flatnonzero(seen[(h % np.uint64(RARE)).astype(np.int64)] == seen[(h % np.uint64(RARE)).astype(np.int64)].min())
                grams.append(h[rare[0]])
                sizes.append(size)
                needed.append(_signature(runs[most]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(grams, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _longs(needed)], ["query_id", "gram", "size", "needed"])

    return asked.select("query_id", terms.alias("terms")).where(F.exists("terms", lambda t: t != "")).mapInArrow(run, f"query_id {kind}, gram long, size int, needed array<long>")


def met_units(units: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, unit_id) of units that may match, without an index. A query meets the units that hold the one run of six characters of its terms (of three or
    fewer, where none is so long) that looks rarest in a sample, and of these, in the join itself, only those whose signature has all bits of its own;
    so what leaves the join is little more than the matches. Of units only runs by which some query asks are moved, by a hashed filter of fixed size."""
    kind = units.schema["unit_id"].dataType.simpleString()
    texts = units.select("unit_id", _text("title", "content").alias("text"))
    signed = _meeting(asked, _counted(texts.sample(SAMPLE, seed=0)))
    slot = F.pmod("gram", F.lit(SLOTS).cast("long"))
    told = signed.groupBy((slot / 64).cast("long").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(gram, {SLOTS}L) % 64 as int))")).alias("bits"), F.collect_set("size").alias("sizes")).collect()  # at most SLOTS / 64 rows
    wanted = np.zeros(SLOTS // 64, np.int64)
    for r in told:
        wanted[r["w"]] = r["bits"]
    sizes = tuple(sorted({n for r in told for n in r["sizes"]} | {GRAM}))

    def run(batches):
        open_ = np.unpackbits(wanted.view(np.uint8), bitorder="little").astype(bool)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                of, grams, signatures = [], [], []
                for i, text in enumerate(part.column(1)):
                    runs = _hashed(text.as_py(), sizes)
                    met = np.concatenate([h[open_[(h % np.uint64(SLOTS)).astype(np.int64)]] for h in runs.values()])
                    if len(met):
                        of += [i] * len(met)
                        grams.append(met.view(np.int64))
                        signatures += [_signature(np.concatenate([h for n, h in runs.items() if n <= GRAM]))] * len(met)
                if of:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(np.concatenate(grams)), _longs(signatures)], ["unit_id", "gram", "signature"])

    held = texts.mapInArrow(run, f"unit_id {kind}, gram long, signature array<long>")
    lacks = [F.get("needed", F.lit(i)).bitwiseAND(F.bitwise_not(F.get("signature", F.lit(i)))) == 0 for i in range(WORDS)]
    return held.join(signed, "gram").where(reduce(lambda a, b: a & b, lacks)).select("query_id", "unit_id")


def term_rank(phrases: Column, keywords: Column, text: Column, words: Column, typical: int = 100) -> Column:
    """How densely a text speaks of the terms, 0 to 1: the mean over terms of n / (n + 1.2 (0.25 + 0.75 words / typical)), where n is the number of places
    (words for keywords, occurrences for phrases) that hold the term. More places count less and less, longer texts dilute. `text` and its `words` should
    be columns, not expressions, which would be computed for every term."""
    length = 1.2 * (0.25 + 0.75 * F.size(words) / typical)
    held = lambda n: n / (n + length)
    inside = F.transform(keywords, lambda k: held(F.size(F.filter(words, lambda w: w.contains(F.lower(k))))))
    spoken = F.transform(phrases, lambda p: held((F.length(text) - F.length(F.replace(text, F.lower(p), F.lit("")))) / F.length(p)))
    ranks = F.concat(inside, spoken)
    return F.when(F.size(ranks) > 0, F.aggregate(ranks, F.lit(0.0), lambda s, x: s + x) / F.size(ranks)).otherwise(0.0)


def batch_lexical(units: DataFrame, prepared: DataFrame, top: int | None = None, index: tuple[DataFrame, DataFrame] | None = None, with_rank: bool = False) -> DataFrame:
    """Matches of every query of a prepared table: query_id, unit columns, score and, with `top`, rank.

    An inverted index of grams (`index`, as read_postings gives it) finds the units that hold the rarest grams of a query; without one, `met_units` does. Texts are read once for each candidate, then every term is looked for. `with_rank` adds the term rank to the score.
    """
    asked = prepared.select("query_id", "phrases", "keywords").where(F.size("phrases") + F.size("keywords") > 0)
    met = met_units(units, asked) if index is None else candidates(index[0], _anchors(_terms(asked).join(index[1], "gram", "left")))
    p, k, text = F.col("phrases"), F.col("keywords"), _text("title", "content")
    # Pairs take the terms along, not the texts, which move once.
    hits = met.join(asked, "query_id").join(units, "unit_id").where(_once(text, lambda t: text_match(p, k, t)))
    rank = lambda t: _once(F.filter(F.split(t, r"\s+"), lambda w: w != ""), lambda w: term_rank(p, k, t, w)) if with_rank else None
    scored = hits.withColumn("score", _once(text, lambda t: lexical_score(p, k, rank(t), t))).select("query_id", *units.columns, "score")
    return ranked(scored, "score", top) if top else scored


def totals(hits: DataFrame) -> DataFrame:
    """(query_id, total): how many units each query matches in all."""
    return hits.groupBy("query_id").agg(F.count("*").alias("total"))


def ranked(hits: DataFrame, by: str, top: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(by), _unit_order(), "document_id", "unit_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different length or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot / size).otherwise(0.0)


def _blocks(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Blocks of at most `size` rows (key, v) with vectors of one length: keys, dims, x. They are formed inside the tasks that read the rows. Vectors of single
    precision travel as such."""
    width = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64

    def run(batches):
        for b in batches:
            v = b.column(1)
            lengths = np.array([0 if n is None else n for n in pc.list_value_length(v).to_pylist()], np.int64)
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                for lo in range(0, len(at) if dims else 0, size):
                    part = pa.array(at[lo : lo + size])
                    x = v.take(part).flatten().to_numpy(zero_copy_only=False).astype(width)
                    keys = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), b.column(0).take(part))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([dims], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["keys", "dims", "x"])

    return rows.mapInArrow(run, f"keys array<{kind}>, dims int, x binary")


class _Best:
    """The `top` units of each of n queries among those shown so far, by similarity and, where it is equal, by their keys (structs)."""

    def __init__(self, n: int, top: int) -> None:
        self.top, self.edge = top, np.full(n, -np.inf)
        self.q, self.s, self.keys, self.held = [], [], [], 0

    def show(self, first: int, s: np.ndarray, keys: pa.Array) -> None:
        """Similarities of the queries from `first` on (rows) to units (columns); those that are no numbers take no part."""
        edge = self.edge[first : first + len(s)]
        many = np.flatnonzero((s >= edge[:, None]).sum(1) > self.top)
        if len(many):
            edge = edge.copy()
            edge[many] = np.partition(np.nan_to_num(s[many], nan=-np.inf), s.shape[1] - self.top, axis=1)[:, -self.top]
        a, c = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
        self.q.append(a + first)
        self.s.append(s[a, c])
        self.keys.append(keys.take(pa.array(c)))
        self.held += len(a)
        if self.held > max(CELLS, 2 * self.top * len(self.edge)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Drops what is not among the best; query places, similarities and keys of what is."""
        q, s, keys = np.concatenate(self.q), np.concatenate(self.s), pa.concat_arrays(self.keys)
        parts = {f"k{i}": k for i, k in enumerate(keys.flatten())}
        order = pc.sort_indices(pa.table({"q": q, "s": s, **parts}), sort_keys=[("q", "ascending"), ("s", "descending"), *[(k, "ascending") for k in parts]], null_placement="at_start").to_numpy()
        q = q[order]
        start = np.searchsorted(q, np.arange(len(self.edge) + 1))
        keep = np.arange(len(q)) - start[q] < self.top
        s = s[order]
        full = np.flatnonzero(np.diff(start) >= self.top)
        self.edge[full] = s[start[full] + self.top - 1]
        q, s, keys = q[keep], s[keep], keys.take(pa.array(order[keep]))
        self.q, self.s, self.keys, self.held = [q], [s], [keys], len(q)
        return q, s, keys


#: Cells of a matrix of similarities that are computed at once: 32 MB.
CELLS = 1 << 22


def semantic(units: DataFrame, vectors: DataFrame, top: int = 10, block: int = 16384, rows: int = 2048, fan: int = 64) -> DataFrame:
    """The `top` embedded units nearest to each query (query_id, query_vector): query_id, unit columns without the vector, similarity, rank.

    Exact. Units and queries meet as blocks: every block of units faces every block of queries, multiplied as matrices. A block of queries goes out in as
    many copies as there are `fan` blocks of units, so no key gathers all units, and each copy yields its best over all units it faces. These few rows
    are ranked before they meet the units' other columns. Similarity to a vector of another length is 0.
    """
    query_kind, single = vectors.schema["query_id"].dataType.simpleString(), units.schema["embedding"].dataType.simpleString() == "array<float>"
    key, width = F.struct(_unit_order().alias("kind"), "document_id", "unit_id"), np.float32 if single else np.float64
    ready = units.where(F.col("embedding_status") == "embedded").select(key.alias("key"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    kind = ready.schema["key"].dataType.simpleString()
    n, (m, dims) = vectors.count(), ready.agg(F.count("*"), F.max(F.size("v"))).first()
    # 64 MB of doubles at most, of queries or units, meet in a task.
    most = max(1, (64 << 20) // (8 * max(dims or 1, 1)))
    parts, copies = max(1, -(-n // min(block, most))), max(1, -(-m // min(rows * fan, most)))
    numbered = vectors.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    # About `block` rows each, since queries are dealt by their hash.
    asked = numbered.groupBy("block").agg(F.collect_list(F.struct("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))).alias("asked")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    packed = _blocks(ready, min(rows, most), kind).withColumn("copy", F.pmod(F.xxhash64(F.try_element_at("keys", F.lit(1))), F.lit(copies)).cast("int"))
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("block", "copy").agg(F.collect_list(F.struct("keys", "dims", "x")).alias("held"))
    faced = packed.join(asked, ["block", "copy"]).select("held", "asked")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                held, asked = row.column(0).flatten(), row.column(1).flatten()
                lengths = np.array(pc.fill_null(pc.list_value_length(asked.field("query_vector")), 0), np.int64)
                flat, ends = asked.field("query_vector").flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
                best, seen = _Best(len(lengths), top), {}
                for j, dims in enumerate(held.field("dims").to_pylist()):
                    keys = held.field("keys").slice(j, 1).flatten()
                    x = np.frombuffer(held.field("x")[j].as_buffer(), width).reshape(-1, dims).astype(np.float64)
                    if dims not in seen:
                        fit = lengths == dims
                        q = np.zeros((len(lengths), dims))
                        q[fit] = flat[(ends[fit] - dims)[:, None] + np.arange(dims)]
                        seen[dims] = q, np.sqrt((q * q).sum(1)), fit
                    q, own, fit = seen[dims]
                    norm, step = np.sqrt((x * x).sum(1)), max(1, CELLS // len(x))
                    for lo in range(0, len(q), step):
                        norms = own[lo : lo + step, None] * norm[None, :]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            s = np.where((norms > 0) & fit[lo : lo + step, None], q[lo : lo + step] @ x.T / norms, 0.0)
                        best.show(lo, s, keys)
                a, s, keys = best.cut()
                yield pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(a)), keys, pa.array(s)], ["query_id", "key", "similarity"])

    near = faced.mapInArrow(run, f"query_id {query_kind}, key {kind}, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "key.kind", "key.document_id", "key.unit_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("key.unit_id").alias("unit_id"), "similarity", "rank")
    keep = [c for c in units.columns if c != "embedding"]
    return best.join(units.select(*keep), "unit_id").select("query_id", *keep, "similarity", "rank")


def sketches(units: DataFrame, bits: int = 512, seed: int = 0) -> DataFrame:
    """(unit_id, dims, sketch): an index of embedded units by the signs of `bits` random projections, the same for the same length and seed. Two vectors differ in
    a share of their bits that is their angle over pi, whatever the vectors look like. A sketch of 512 bits has 64 bytes where a vector of 1,024 dimensions has 4,096.
    Store it with the units' embeddings; rows of new units are appended."""
    ready = units.where(F.col("embedding_status") == "embedded").select("unit_id", F.col("embedding").cast("array<double>").alias("v"))
    kind = ready.schema["unit_id"].dataType.simpleString()

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            found, dims = _signs(b.column(1), planes, bits, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(found, pa.binary())], ["unit_id", "dims", "sketch"])

    return ready.mapInArrow(run, f"unit_id {kind}, dims int, sketch binary").where("dims > 0")


def _signs(vectors: pa.Array, planes: dict[int, np.ndarray], bits: int, seed: int) -> tuple[list[bytes], np.ndarray]:
    dims = np.array([n or 0 for n in pc.list_value_length(vectors).to_pylist()], np.int32)
    out = [b""] * len(dims)
    for n in np.unique(dims[dims > 0]).tolist():
        if n not in planes:
            planes[n] = np.random.default_rng([seed, n]).standard_normal((n, bits))
        at = np.flatnonzero(dims == n)
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        packed = np.packbits(x @ planes[n] > 0, axis=1)
        for i, row in zip(at.tolist(), packed):
            out[i] = row.tobytes()
    return out, dims


def semantic_approximate(units: DataFrame, vectors: DataFrame, index: DataFrame, top: int = 10, candidates: int = 400, bits: int = 512, seed: int = 0, block: int = 1024, share: int = 8192) -> DataFrame:
    """Like semantic, over an index of sketches(): each query's `candidates` units of fewest differing bits are compared by their vectors and ranked. What is
    compared grows with queries times candidates, not with queries times units; only sketches of all units are read. The ranking is exact among
    candidates; a true neighbour is missed where `candidates` sketches look nearer, so measure recall for data of your own."""
    queries = vectors.select("query_id", F.col("query_vector").cast("array<double>").alias("embedding"), F.lit("embedded").alias("embedding_status"))
    asked = sketches(queries.withColumnRenamed("query_id", "unit_id"), bits, seed).withColumnsRenamed({"unit_id": "query_id", "sketch": "wanted"})
    query_kind, unit_kind = asked.schema["query_id"].dataType.simpleString(), index.schema["unit_id"].dataType.simpleString()
    n, m = vectors.count(), index.count()
    parts, slices = max(1, -(-n // block)), max(1, -(-m // share))
    # Slices of units and blocks of queries by hash; a pair of them is a key of its own, so that all pairs spread over the tasks, and a task holds one pair at a time.
    packed = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).groupBy("block", "dims").agg(F.collect_list(F.struct("query_id", "wanted")).alias("asked"))
    packed = packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    held = index.withColumn("slice", F.pmod(F.xxhash64("unit_id"), F.lit(slices)).cast("int")).groupBy("slice", "dims").agg(F.collect_list(F.struct("unit_id", "sketch")).alias("held"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    faced = held.join(packed.hint("shuffle_hash"), ["slice", "block", "dims"]).select("held", "asked")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                mine, theirs = row.column(0).flatten(), row.column(1).flatten()
                x = np.frombuffer(b"".join(mine.field("sketch").to_pylist()), np.uint8).reshape(len(mine), -1)
                q = np.frombuffer(b"".join(theirs.field("wanted").to_pylist()), np.uint8).reshape(len(theirs), -1)
                far = np.stack([np.bitwise_count(x ^ one).sum(1, dtype=np.int32) for one in q])
                if far.shape[1] > candidates:
                    near = np.argpartition(far, candidates - 1, axis=1)[:, :candidates]
                else:
                    near = np.broadcast_to(np.arange(far.shape[1]), far.shape)
                a = np.repeat(np.arange(len(q)), near.shape[1])
                c = near.ravel()
                yield pa.RecordBatch.from_arrays([theirs.field("query_id").take(pa.array(a)), mine.field("unit_id").take(pa.array(c)), pa.array(far[a, c])], ["query_id", "unit_id", "bits"])

    seen = faced.mapInArrow(run, f"query_id {query_kind}, unit_id {unit_kind}, bits int")
    order = W.partitionBy("query_id").orderBy("bits", "unit_id")
    few = seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= candidates).select("query_id", "unit_id")
    met = few.join(units, "unit_id").join(vectors.select("query_id", "query_vector"), "query_id")
    scored = met.withColumn("similarity", cosine(F.col("query_vector"), F.col("embedding"))).drop("query_vector", "embedding")
    return ranked(scored, "similarity", top)


def _both(lexical_hits: DataFrame, semantic_hits: DataFrame) -> DataFrame:
    """(query_id, unit_id, document_id, unit_type, score, similarity, lexical): the union of both, each computed once; `lexical` is the score scaled to 0..1
    within its query, where one value alone gives 1."""
    info, none = ("query_id", "unit_id", "document_id", "unit_type"), F.lit(None).cast("double")
    sides = lexical_hits.select(*info, "score", none.alias("similarity")).unionByName(semantic_hits.select(*info, none.alias("score"), "similarity"))
    merged = sides.groupBy("query_id", "unit_id").agg(*[F.first(c).alias(c) for c in info[2:]], F.max("score").alias("score"), F.max("similarity").alias("similarity"))
    # A window by query, as the ranking that follows, so that both share one exchange.
    query = W.partitionBy("query_id")
    low, high = F.min("score").over(query), F.max("score").over(query)
    scaled = F.when(F.col("score").isNotNull(), F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    return merged.withColumn("lexical", scaled)


def _mixed(weights: tuple[float, float]) -> Column:
    return weights[0] * F.coalesce("lexical", F.lit(0.0)) + weights[1] * F.coalesce((1 + F.col("similarity")) / 2, F.lit(0.0))


def hybrid(lexical_hits: DataFrame, semantic_hits: DataFrame, top: int = 10, weights: tuple[float, float] = (LEXICAL_WEIGHT, SEMANTIC_WEIGHT)) -> DataFrame:
    """Union of both: weights on the min-max normalised score and on (1 + similarity) / 2; a side that is missing gives 0."""
    merged = _both(lexical_hits, semantic_hits).withColumn("relevance", _mixed(weights)).drop("score")
    return ranked(merged, "relevance", top)


def run(units: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """Queries (query_id, text, mode, query_vector) by mode: lexical, semantic or hybrid; without a vector always lexical.
    Returns query_id, unit_id, mode used, relevance, rank."""
    asked = prepare(queries).withColumn("used", F.when(F.col("query_vector").isNull(), "lexical").otherwise(F.col("mode")))
    words = batch_lexical(units, asked.where("used != 'semantic'"))
    vectors = semantic(units, asked.where("used != 'lexical'").select("query_id", "query_vector"), top)
    merged = _both(words, vectors).join(asked.select("query_id", F.col("used").alias("mode")), "query_id")
    relevance = F.when(F.col("mode") == "lexical", F.col("score")).when(F.col("mode") == "semantic", F.col("similarity")).when(F.col("mode") == "hybrid", _mixed((LEXICAL_WEIGHT, SEMANTIC_WEIGHT)))
    found = ranked(merged.withColumn("relevance", relevance).where("mode in ('lexical', 'semantic', 'hybrid')"), "relevance", top)
    return found.select("query_id", "unit_id", "document_id", "unit_type", "relevance", "rank", "mode")


def snippet(content: Column, needles: Column, length: int = 220) -> Column:
    """A window of the content around the first needle that is found, in the order of the needles."""
    text = F.coalesce(content, F.lit(""))
    places = F.filter(F.transform(needles, lambda n: F.instr(F.lower(text), F.lower(n))), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(1)) - length // 4, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, F.lit(length)), F.when(start + length <= F.length(text), "…").otherwise(""))


def shape(hits: DataFrame, documents: DataFrame, pages: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """Rounded scores with file name, page number and the record's values."""
    out = hits.join(documents.select("document_id", "filename"), "document_id", "left")
    if pages is not None:
        out = out.join(pages.select("page_id", "page_number"), "page_id", "left")
    if records is not None:
        out = out.join(records.select("record_id", "value_raw", "normalized_value"), "record_id", "left")
    for c, digits in (("score", 2), ("similarity", 4), ("relevance", 4)):
        if c in out.columns:
            out = out.withColumn(c, F.bround(c, digits))
    return out
