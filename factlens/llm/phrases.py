"""Phrase collocations from a weighted de Bruijn graph of words.

An edge is a run of `words` words (five) within a piece, its weight the number of its occurrences; its nodes are its first and its last
four words. Where a piece ends, or goes on to a run of words that cannot be frequent, the shorter runs that are left are kept as
corrections. So every place of the corpus adds one row, an edge or a correction, and the count of a shorter phrase is the flow through its
node: the weights of all edges that begin with it, and its corrections. Counts are derived from the longest runs down, a length at a time.

Which runs cannot be frequent is known from two tables of hashed counts of fixed size: words and pairs are counted by bucket, then the longer runs
whose pairs may be frequent, and a bucket below the least count holds no frequent one. The filter saves rows and never changes a count: a phrase
that occurs often has no rare run inside. Each task hands on its table in blocks of counts, which are summed block by block. Only its bits
reach the driver (2 MB for 2**24 buckets, whatever the corpus holds).

A phrase whose whole flow goes through one extension stands inside a unary path: paths are compacted, and it is dropped for the longer one.
`paths` follows unary nodes over any distance and returns the passages that they spell.

Null texts are empty, null languages are `und`; texts without a word add nothing; repeated rows count as often as they stand there; an empty
table gives an empty result. Columns other than text and language are not read. Ties have the order of the contract: score, count, phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import discard, encode, materialize, mix

#: Text is read in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: Different grams that a task sums up before it hands them on; a chunk may add as many as it has places.
HELD = 300_000
#: ASCII capitals to small letters, what ends a piece to a line end, the tab to a blank.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
SALTS = 8
#: Buckets of a block of a filter's table.
BLOCK = 4096
#: Tasks for each core that read the texts; one reads several splits, one after the other, in the same memory.
TASKS = 2


class _Chunk:
    """Words of some texts: `code` numbers into `vocabulary`, -1 where a piece ends, `lang` the number of the text's language."""

    def __init__(self, texts: list[bytes], langs: list[int]) -> None:
        # A full stop can't be part of a word here, so it marks the end of a piece.
        rows = pa.array([t.translate(TABLE).replace(b"\n", b" . ") + b" . " for t in texts], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(rows)
        found = split.flatten().dictionary_encode()
        self.vocabulary = found.dictionary.cast(pa.large_binary()).to_pylist()
        code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang = np.repeat(np.array(langs, np.int64), np.diff(split.offsets.to_numpy()))
        kind = np.array([0 if w == b"" else -1 if w == b"." else 1 for w in self.vocabulary], np.int8)
        some = kind[code] != 0
        self.lang, self.code = lang[some], np.where(kind[code] < 0, -1, code)[some]

    def buckets(self, names: list[str], bits: int, words: int) -> list[np.ndarray]:
        """For each place the buckets of its word, of its word and the next one, and so on; of no meaning where a piece ends."""
        shift = np.uint64(64 - bits)
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary] + [0], np.uint64)[self.code]
        seed = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in names], np.uint64)[self.lang]
        runs = [mix(own ^ seed)]
        for k in range(1, words):
            runs.append(mix(runs[-1] * np.uint64(3) + np.r_[own[k:], own[:k]]))
        return [(run >> shift).astype(np.int64) for run in runs]


def _both(at: np.ndarray) -> np.ndarray:
    """Places that are marked as the next one is."""
    return at & np.r_[at[1:], False]


def _alive(chunk: _Chunk, buckets: list[np.ndarray], often: list[np.ndarray]) -> list[np.ndarray]:
    """For 1, 2, ... words the places where a run of so many begins that may be frequent, as all runs inside it may."""
    out: list[np.ndarray] = []
    for bucket, table in zip(buckets, often):
        out.append((_both(out[-1]) if out else chunk.code >= 0) & table[bucket])
    return out


def _chunks(batches):
    """Chunks of (text, lang) batches, each with the names of its languages."""
    for b in batches:
        texts, langs, names, size = [], [], {}, 0
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            texts.append(encode(text))
            langs.append(names.setdefault(lang, len(names)))
            size += len(texts[-1])
            if size >= CHUNK:
                yield _Chunk(texts, langs), list(names)
                texts, langs, names, size = [], [], {}, 0
        if texts:
            yield _Chunk(texts, langs), list(names)


def _often(filters: list, words: int, bits: int) -> list[np.ndarray]:
    """The tables of the runs of 1, 2, ... words, as marks: the first filter is that of words and pairs, the second that of longer runs."""
    tables = [np.unpackbits(f.value, bitorder="little")[: 1 << bits].view(bool) for f in filters]
    return [tables[k > 2] for k in range(1, words + 1)]


def _filter(texts: DataFrame, least: int, bits: int, lengths: range, before: list) -> np.ndarray:
    """One bit a bucket: whether it holds `least` runs of the lengths. With the filter of words and pairs before it, runs without a rare one are counted."""
    kind = np.min_scalar_type(least)

    def count(batches):
        table = np.zeros(1 << bits, np.int32)
        often = _often(before, lengths[0] - 1, bits)
        for chunk, names in _chunks(batches):
            buckets = chunk.buckets(names, bits, lengths[-1])
            at = _alive(chunk, buckets, often)[-1] if often else chunk.code >= 0
            for k in lengths:
                at = _both(at) if k > 1 else at
                np.add.at(table, buckets[k - 1][at], 1)
        counts = np.minimum(table, least).astype(kind).reshape(-1, min(BLOCK, len(table)))  # more than `least` in a task is enough
        some = np.flatnonzero(counts.any(1))
        for start in range(0, len(some), 256):
            part = some[start : start + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[i].tobytes() for i in part], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(min(BLOCK, 1 << bits), np.int64)
        for b in batches:
            block = b.column("block")[0].as_py()
            for counts in b.column("counts").to_pylist():
                total += np.frombuffer(counts, kind)
        held = np.packbits(total >= least, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([held], pa.binary())], ["block", "bits"])

    size = min(BLOCK, 1 << bits) // 8 or 1
    out = np.zeros(max(1, (1 << bits) // BLOCK) * size, np.uint8)
    for block, held in texts.mapInArrow(count, "block long, counts binary").groupBy("block").applyInArrow(add, "block long, bits binary").collect():
        out[block * size : (block + 1) * size] = np.frombuffer(bytes(held), np.uint8)
    return out


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(text, lang), read by few tasks: each hands on every frequent run once and a table of counts, so with a task a split both would grow with
    the splits times the frequent runs."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang")).where("text is not null")
    return texts.coalesce(TASKS * docs.sparkSession.sparkContext.defaultParallelism)


def graph(docs: DataFrame, least: int = 100, words: int = 5, bits: int = 24, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, k, gram, n): edges (k = words) and corrections (k below) with their weights, and at k = 0 all words of a language. Exact for
    phrases that occur `least` times; what holds a word or a pair that cannot is left out. Stored in the shared folder."""
    texts = _texts(docs, lang_col, text_col)
    filters: list = []
    for lengths in (range(1, min(words, 2) + 1), range(3, words + 1)):
        if lengths:
            filters.append(texts.sparkSession.sparkContext.broadcast(_filter(texts, least, bits, lengths, list(filters))))  # 2**bits bits

    def grams(batches):
        often = _often(filters, words, bits)
        held: dict[str, dict[bytes, int]] = {}

        def handed():
            for lang, sums in held.items():
                rows = iter(sums.items())
                while some := list(islice(rows, 50_000)):
                    gram, n = zip(*some)
                    k = [g.count(b" ") + 1 if g else 0 for g in gram]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(gram, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "k", "gram", "n"])
            held.clear()

        for chunk, names in _chunks(batches):
            code, lang, size = chunk.code, chunk.lang, len(chunk.vocabulary) + 1
            alive = _alive(chunk, chunk.buckets(names, bits, words), often)
            at = np.flatnonzero(alive[0])
            key = lang[at] * size + code[at] + 1
            # A run and its beginnings get numbers, one word after the other.
            parts, number = np.unique(key, return_inverse=True)
            known = [(parts // size, parts % size)]
            for j in range(1, words):
                step = np.where(alive[j][at], code[np.minimum(at + j, len(code) - 1)] + 1, 0)
                parts, number = np.unique(number * size + step, return_inverse=True)
                known.append((parts // size, parts % size))
            columns, row = [], np.arange(len(parts))
            for above, step in reversed(known):
                columns.append(step[row].tolist())
                row = above[row]
            vocabulary, sums = [b"", *chunk.vocabulary], [held.setdefault(name, {}) for name in names]
            for of, n, gram in zip(row.tolist(), np.bincount(number, minlength=len(parts)).tolist(), zip(*reversed(columns))):
                seen = b" ".join([vocabulary[c] for c in gram if c])
                sums[of][seen] = sums[of].get(seen, 0) + n
            for of, n in enumerate(np.bincount(lang[code >= 0], minlength=len(names)).tolist()):
                sums[of][b""] = sums[of].get(b"", 0) + n
            if sum(map(len, held.values())) > HELD:
                yield from handed()
        yield from handed()

    return materialize(texts.mapInArrow(grams, "lang string, k int, gram string, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")), "grams")


def levels(edges: DataFrame, words: int = 5) -> list[DataFrame]:
    """(lang, gram, n) of the phrases of 1, 2, ... words, from the flow of edges: a phrase of k words occurs as often as all phrases of
    k + 1 words that begin with it, and as its corrections say."""
    out: list[DataFrame] = []
    for k in range(words, 0, -1):
        level = edges.where(F.col("k") == k).select("lang", "gram", "n")
        if out:
            level = level.unionByName(out[0].select("lang", F.substring_index("gram", " ", k).alias("gram"), "n"))
            level = materialize(level.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "flow")
        out.insert(0, level)
    return out


def frequent(counts: list[DataFrame], least: int = 100) -> DataFrame:
    """(lang, k, gram, f, through) of the phrases that occur `least` times; through: the flow that goes on, or comes, by the one
    extension that takes most of it. Where it is all of f the phrase is inside a unary path."""
    each = [c.where(F.col("n") >= least).select("lang", F.lit(k).alias("k"), "gram", F.col("n").alias("f")) for k, c in enumerate(counts, 1)]
    own = materialize(reduce(DataFrame.unionByName, each), "frequent")
    longer = own.where("k > 1")
    cut = [F.expr("substring_index(gram, ' ', k - 1)"), F.expr("substring(gram, instr(gram, ' ') + 1)")]
    through = longer.select("lang", F.explode(F.array(*cut)).alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("through"))
    return own.join(through, ["lang", "gram"], "left")


def paths(counts: list[DataFrame], least: int = 100) -> DataFrame:
    """(lang, path, n_words, n): the compacted unary paths of the frequent edges, each a passage that its n occurrences share word for
    word; single edges with branches on both sides are paths of their own.

    Two edges are joined where their node has the same weight as both: nothing else enters or leaves it. Paths have no cycle, since a piece
    would have to enter it. Each edge finds the first one of its path by doubling its reach, in rounds that grow with the logarithm of the
    longest path."""
    words = len(counts)
    edges = counts[-1].where(F.col("n") >= least)
    nodes = counts[-2].where(F.col("n") >= least).select("lang", F.col("gram").alias("node"), "n")
    left = edges.select("lang", F.col("gram").alias("before"), F.expr("substring(gram, instr(gram, ' ') + 1)").alias("node"), "n")
    right = edges.select("lang", "gram", F.substring_index("gram", " ", words - 1).alias("node"), "n")
    joined = right.join(nodes, ["lang", "node", "n"]).join(left, ["lang", "node", "n"]).select("lang", "gram", "before")
    state = edges.join(joined, ["lang", "gram"], "left").select("lang", "gram", "n", F.coalesce("before", "gram").alias("first"), F.col("before").isNotNull().cast("int").alias("steps"))
    state = materialize(state, "paths")
    while True:
        reach = state.select("lang", F.col("gram").alias("first"), F.col("first").alias("next"), F.col("steps").alias("more"))
        after = materialize(state.join(reach, ["lang", "first"]).select("lang", "gram", "n", F.col("next").alias("first"), (F.col("steps") + F.col("more")).alias("steps")), "paths")
        moved = after.agg(F.sum("steps")).first()[0] != state.agg(F.sum("steps")).first()[0]
        discard(state)
        state = after
        if not moved:
            break
    last = F.transform(F.array_sort(F.collect_list(F.struct("steps", F.substring_index("gram", " ", -1).alias("word")))), lambda x: x["word"])
    spelt = state.groupBy("lang", "first", "n").agg(last.alias("tail"), F.count("*").alias("edges"))
    return spelt.select("lang", F.concat_ws(" ", F.substring_index("first", " ", words - 1), F.array_join("tail", " ")).alias("path"), (F.col("edges") + words - 1).alias("n_words"), "n")


def collocations(docs: DataFrame, least: int = 100, words: int = 5, top: int = 2000, bits: int = 24, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases of 2 to `words` words that occur `least` times."""
    edges = graph(docs, least, words, bits, lang_col, text_col)
    total = edges.where("k = 0").select("lang", F.col("n").alias("n"))
    counts = levels(edges, words)
    often = materialize(frequent(counts, least), "phrases")
    # Many phrases share a part, up to a common first word of a third of them: parts stand there SALTS times, phrases are dealt out.
    parts = often.select("lang", F.col("gram").alias("part"), F.col("f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ends = often.where("k > 1 and coalesce(through < f, true)").withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int"))
    cuts = ends.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.select("lang", "salt", F.col("gram").alias("phrase"), F.col("f").alias("a"), "cut", F.expr("substring_index(gram, ' ', cut)").alias("left"), F.expr("substring_index(gram, ' ', cut - k)").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"part": side, "f": name}), ["lang", side, "salt"])
    cuts = cuts.join(total, "lang")
    score = F.expr("(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * 1000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    scored = best.select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first ones of a language are among the first ones of its shares.
    share = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    share = share.withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    ranked = share.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_debruijn_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: collocations of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM lines),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
sized AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM starts),
counted AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM sized GROUP BY ALL HAVING count(*) >= 100),
inside AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, f
  FROM (SELECT lang, phrase, k, f, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT lang, phrase, k, f, unnest(range(2, k)) AS m FROM counted WHERE k > 2))),
most AS (SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, unnest(range(1, c.k)) AS cut
  FROM counted c LEFT JOIN most m USING (lang, phrase) WHERE c.k >= 2 AND (m.longer IS NULL OR 100 * m.longer < 100 * c.f)),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * u.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts u JOIN total t USING (lang)
  JOIN counted l ON l.lang = u.lang AND l.phrase = array_to_string(string_split(u.phrase, ' ')[1:u.cut], ' ')
  JOIN counted r ON r.lang = u.lang AND r.phrase = array_to_string(string_split(u.phrase, ' ')[u.cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""
