"""Text analytics over a corpus of units (unit_id, document_id, content, ...): terms, phrases, topics, clouds, summaries.

With `by=("document_id",)` the same operators run for every document at once: the columns are added to every group key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import label_case
from .windows import cap_per_key, global_budget, top_sources

# Words that carry no content.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "if", "in", "into",
    "is", "it", "its", "of", "on", "or", "our", "per", "she", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this",
    "to", "was", "we", "were", "what", "which", "who", "will", "with", "would", "you", "your", "also", "each", "any", "all", "not", "no",
    "other", "more", "most", "some", "such", "only", "same", "very", "can", "may", "shall", "should", "do", "does", "did", "done", "being",
    "about", "above", "after", "again", "against", "before", "below", "between", "both", "down", "during", "few", "further", "here", "how",
    "just", "nor", "now", "off", "once", "out", "over", "own", "under", "until", "up", "when", "where", "why",
]
TOKEN = r"[a-z0-9]+(?:['-][a-z0-9]+)*"


def corpus(units: DataFrame, per_document: int | None = None, max_chars: int | None = None, total_chars: int | None = None, by_document_order: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """Units with flattened content. What is cut is asked for: texts to max_chars (`truncated` says where), the first units of each document,
    and a budget over all in order of document and unit."""
    flat = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", " "))
    cut = F.length(flat) > max_chars if max_chars else F.lit(False)
    out = units.withColumn("truncated", cut).withColumn("content", F.substring(flat, 1, max_chars) if max_chars else flat).where("content != ''")
    if per_document:
        out = cap_per_key(out, ["document_id"], list(by_document_order), per_document)
    return global_budget(out, "document_id", list(by_document_order), F.length("content"), total_chars).drop("used") if total_chars else out


def corpus_stats(built: DataFrame) -> DataFrame:
    return built.agg(F.count("*").alias("units"), F.countDistinct("document_id").alias("documents"), F.sum(F.length("content")).alias("chars"), F.count_if("truncated").alias("truncated_units"))


def tokens(c: Column, unicode: bool = False) -> Column:
    """Lower-case tokens of 2 to 40 characters; ASCII by default, so accented letters split words."""
    pattern = TOKEN.replace("a-z0-9", r"\p{L}\p{N}") if unicode else TOKEN
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), 0), lambda t: F.length(t).between(2, 40))


def content_tokens(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Tokens that are neither stopwords nor all digits."""
    return F.filter(tokens(c), lambda t: ~t.isin(stopwords) & ~t.rlike("^[0-9]+$"))


def ngrams(c: Column, n_min: int = 2, n_max: int = 3, min_chars: int = 1) -> Column:
    """Runs of n tokens of so many characters, joined by a space. `c` should be a column, not an expression, which would be computed for every run."""

    def runs(n: int) -> Column:
        start = F.sequence(F.lit(1), F.size(c) - n + 1)
        if min_chars > 1:
            start = F.filter(start, lambda i: F.forall(F.slice(c, i, n), lambda w: F.length(w) >= min_chars))
        return F.when(F.size(c) >= n, F.transform(start, lambda i: F.array_join(F.slice(c, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(n_min, n_max + 1)])


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def _documents(units: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return units.groupBy(*by).agg(F.countDistinct("document_id").alias("n_docs")) if by else units.agg(F.countDistinct("document_id").alias("n_docs"))


def _with(df: DataFrame, other: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return df.join(other, list(by)) if by else df.crossJoin(F.broadcast(other))  # one row without groups


def tallied(units: DataFrame, terms: Column, keep: list[str]) -> DataFrame:
    """(keep, term, n): each term of a unit once, with how often it stands there. Counted within the row, along its sorted terms, so that a task
    streams whatever the size of its split."""
    split = units.select(*keep, F.sort_array(F.array_compact(terms)).alias("__terms"))
    split = split.withColumn("__starts", F.array_compact(F.transform("__terms", lambda t, i: F.when((i == 0) | (t != F.get("__terms", i - 1)), i))))
    ends = F.concat(F.slice("__starts", 2, F.greatest(F.size("__starts"), F.lit(1))), F.array(F.size("__terms")))
    runs = F.zip_with("__starts", ends, lambda a, b: F.struct(F.get("__terms", a).alias("term"), (b - a).cast("long").alias("n")))
    return split.select(*keep, F.explode_outer(runs).alias("run")).select(*keep, "run.term", "run.n").where("term is not null")


def counts(units: DataFrame, terms: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(term, freq, df): occurrences and documents. Occurrences by term and document come first, so no distinct count is expanded.

    They are dealt by term and document before they are summed: what a unit holds more than once is one row already, so a sum before the exchange
    would save nothing, and its table of all terms of all documents of a split would grow with the split."""
    keys = list(dict.fromkeys([*by, "term", "document_id"]))
    once = tallied(units, terms, list(dict.fromkeys([*by, "document_id"]))).repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))
    if "document_id" in by:
        return once.select(*by, "term", F.col("n").alias("freq"), F.lit(1).cast("long").alias("df"))
    return once.groupBy(*by, "term").agg(F.sum("n").alias("freq"), F.count("*").alias("df"))


def term_stats(units: DataFrame, terms: Column | None = None, min_freq: int = 2, min_chars: int = 3, top: int | None = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """Terms with freq, df and score = freq * idf; the most frequent ones if `top` is given."""
    terms = content_tokens(F.col("content")) if terms is None else terms
    kept = counts(units, terms, by).where((F.col("freq") >= min_freq) & F.forall(F.split("term", " "), lambda w: F.length(w) >= min_chars))
    # A group of one document needs no count of its documents.
    met = kept.withColumn("n_docs", F.lit(1).cast("long")) if "document_id" in by else _with(kept, _documents(units, by), by)
    scored = met.withColumn("score", F.col("freq") * idf(F.col("df"), F.col("n_docs"))).drop("n_docs")
    order = [F.desc("freq"), F.desc("df"), F.col("term")]
    if top is None:
        return scored
    return cap_per_key(scored, list(by), order, top) if by else scored.orderBy(*order).limit(top)


#: Hash slots of a filter of frequent terms: 2^20 bits, 128 KB, whatever the size of the corpus.
SLOTS = 1 << 20


def frequent_filter(frequent: DataFrame) -> DataFrame:
    """One row with the hash slots of `term`, as an array of 64-bit words. It may let rare terms pass, and never keeps a given one out."""
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS))
    words = frequent.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    every = frequent.sparkSession.range(SLOTS // 64).join(words, F.col("id") == F.col("w"), "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("slots"))


def may_be_frequent(slots: Column, term: Column) -> Column:
    slot = F.pmod(F.xxhash64(term), F.lit(SLOTS))
    return F.getbit(F.get(slots, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _pairs(words: Column) -> Column:
    """Each word with the next; null where either is null, and at the end."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))


def _pass(units: DataFrame, array: str, frequent: DataFrame) -> DataFrame:
    """The array of terms with those nulled that a filter of frequent ones leaves out."""
    met = units.crossJoin(F.broadcast(frequent_filter(frequent)))
    return met.withColumn(array, F.transform(array, lambda t: F.when(may_be_frequent(F.col("slots"), t), t))).drop("slots")


def phrase_candidates(units: DataFrame, top: int | None = None, min_freq: int = 2, min_chars: int = 3, probe: int = 1000) -> DataFrame:
    """Units with `__phrases`: every occurrence of each phrase of two or three content words that may be frequent enough, a priori.

    No phrase is more frequent than a part of it. Words are counted first, then pairs of frequent words, without their documents. With `top`, pairs
    of the `probe` commonest words suffice: as many of them as are listed give a bound that every listed phrase reaches, and phrases are built of words
    that reach it. Without, they are built of frequent pairs. What was found frequent is passed on as a hashed filter of fixed size; nothing that
    reaches the bound is left out, so counts of what does are whole.
    """
    split = units.withColumn("__words", F.transform(content_tokens(F.col("content")), lambda w: F.when(F.length(w) >= min_chars, w)))

    def counted(df: DataFrame, terms: Column) -> DataFrame:
        return df.select(F.explode_outer(terms).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)

    words = counted(split, F.col("__words"))
    common = words.orderBy(F.desc("freq"), "term").limit(max(top, probe)) if top else words
    pairs = counted(_pass(split.select("__words"), "__words", common), _pairs(F.col("__words")))
    if top:
        bound = pairs.orderBy(F.desc("freq")).limit(top).agg(F.when(F.count("*") == top, F.min("freq")).otherwise(min_freq).alias("bound"))
        split = _pass(split, "__words", words.crossJoin(F.broadcast(bound)).where("freq >= bound"))
    paired = split.withColumn("__pairs", _pairs(F.col("__words")))
    if not top:
        paired = _pass(paired, "__pairs", pairs)
    rest = F.greatest(F.size("__words"), F.lit(1))
    third = F.zip_with(F.slice("__pairs", 2, rest), F.slice("__words", 3, rest), lambda p, w: F.when(p.isNotNull(), w))
    triples = F.zip_with("__pairs", third, lambda p, w: F.concat(p, F.lit(" "), w))
    return paired.withColumn("__phrases", F.concat("__pairs", triples)).drop("__pairs", "__words")


def phrases(units: DataFrame, top: int | None = 30, by: tuple[str, ...] = (), min_chars: int = 3) -> DataFrame:
    """Phrases of two and three content words; those with a short word are never counted, as term_stats would drop them. Over a whole corpus
    only what may be frequent is counted by document (`phrase_candidates`); a single document's phrases are few."""
    if not by:
        return term_stats(phrase_candidates(units, top, min_chars=min_chars), F.col("__phrases"), min_chars=min_chars, top=top)
    split = units.withColumn("__tokens", content_tokens(F.col("content")))
    return term_stats(split, ngrams(F.col("__tokens"), min_chars=min_chars), min_chars=min_chars, top=top, by=by)


def keywords(units: DataFrame, top_terms: int | None = 60, top_phrases: int | None = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Phrases and terms with kind, rank (phrases first) and a reason."""
    both = phrases(units, top_phrases, by).withColumn("kind", F.lit("phrase")).unionByName(term_stats(units, top=top_terms, by=by).withColumn("kind", F.lit("term")))
    reason = F.format_string("occurs %d times in %d documents", "freq", "df")
    return both.withColumn("reason", reason)


def display_forms(units: DataFrame, terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(term, display): the most frequent spelling in the texts, first letter raised if it is all lower case."""
    surface = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("(?i)" + TOKEN), 0)
    seen = units.select(*by, F.explode(surface).alias("surface")).withColumn("term", F.lower("surface")).join(terms.select(*by, "term").distinct(), [*by, "term"])
    best = seen.groupBy(*by, "term", "surface").agg(F.count("*").alias("n")).groupBy(*by, "term").agg(F.min(F.struct((-F.col("n")).alias("n"), "surface")).alias("s"))
    shown = F.col("s.surface")
    return best.select(*by, "term", F.when(shown == F.lower(shown), F.initcap(shown)).otherwise(shown).alias("display"))


def cloud(terms: DataFrame, top: int | None = 40, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds weight = score / highest score."""
    peak = terms.groupBy(*by).agg(F.max("score").alias("__m")) if by else terms.agg(F.max("score").alias("__m"))
    out = _with(terms, peak, by).withColumn("weight", F.col("score") / F.col("__m")).drop("__m")
    order = [F.desc("weight"), F.desc("freq"), F.col("term")]
    if top is None:
        return out
    return cap_per_key(out, list(by), order, top) if by else out.orderBy(*order).limit(top)


def _bounded(terms: DataFrame, most: int = 1000) -> list[str]:
    """The words of a top list, whose size is a parameter; a table of all terms is refused."""
    words = [r["term"] for r in terms.select("term").distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"a top list of at most {most} terms is wanted here")
    return words


def _of(words: list[str]) -> Column:
    """The tokens of a unit that are among the words, which are content tokens themselves."""
    return F.filter(tokens(F.col("content")), lambda t: t.isin(words))


def cooccurrence(units: DataFrame, terms: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both, jaccard) of pairs a < b of the given terms, by the units in which they stand. `terms` is a top list, so
    pairs within a unit are bounded by its length squared, and one pass over the units counts terms (as a with a) and pairs."""
    listed = F.array(*map(F.lit, _bounded(terms))).cast("array<string>")
    sets = units.select(F.array_sort(F.array_intersect(tokens(F.col("content")), listed)).alias("t"))
    # Outer explosions, since Spark puts a filter that computes the lists once more before the others.
    ends = sets.select(F.posexplode_outer("t").alias("i", "a"), "t").select("a", F.explode_outer(F.slice("t", F.col("i") + 1, F.size("t"))).alias("b")).where("b is not null")
    counted = ends.groupBy("a", "b").agg(F.count("*").alias("both"))
    alone = F.when(F.col("a") == F.col("b"), F.col("both"))
    # As many rows as there are pairs of listed terms: their singles are spread over them as a map.
    singles = counted.agg(F.map_from_entries(F.collect_list(F.when(alone.isNotNull(), F.struct("a", "both")))).alias("n"))
    out = counted.where("a < b").crossJoin(singles).withColumns({"n_a": F.col("n")[F.col("a")], "n_b": F.col("n")[F.col("b")]}).drop("n")
    return out.withColumn("jaccard", F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")))


def topics(units: DataFrame, k: int = 60, jaccard: float = 0.3, max_topics: int = 12, members: int = 6, label_terms: int = 2, min_score: float = 1.0) -> DataFrame:
    """(topic, label, score, terms): greedy leader clustering of the k most frequent terms.

    Pair counts come from Spark; the greedy pass is over k terms and at most k squared pairs, whatever the size of the corpus.
    """
    spark = units.sparkSession
    scored = term_stats(units, top=None)
    order = [r.asDict() for r in scored.orderBy(F.desc("freq"), "term").limit(k).collect()]
    top = spark.createDataFrame([(r["term"],) for r in order], "term string")
    near = {(r["a"], r["b"]) for r in cooccurrence(units, top).where(F.col("jaccard") >= jaccard).select("a", "b").collect()}
    score, taken, out = {r["term"]: r["score"] for r in order}, set(), []
    for leader in score:
        if leader in taken or len(out) == max_topics:
            continue
        group = [t for t in score if t not in taken and (t == leader or (min(t, leader), max(t, leader)) in near)]
        taken.update(group)
        best = sorted(group, key=lambda t: (-score[t], t))[:members]
        out.append((len(out) + 1, best, float(sum(score[t] for t in best))))
    rows = [(n, best, s) for n, best, s in out if s >= min_score]
    frame = spark.createDataFrame(rows, "topic int, terms array<string>, score double")
    label = F.array_join(F.transform(F.slice("terms", 1, label_terms), lambda t: label_case(t)), " / ")
    return frame.select("topic", label.alias("label"), "score", "terms")


def topic_documents(found: DataFrame, units: DataFrame, top: int | None = None) -> DataFrame:
    """(topic, document_id, terms, score): a document supports a topic by its terms; each counts with its frequency in the corpus. With
    `top`, the documents of the highest scores of each topic."""
    wanted = found.select("topic", F.explode("terms").alias("term"))
    hits = units.select("document_id", F.explode(_of(_bounded(wanted))).alias("term")).groupBy("term", "document_id").agg(F.count("*").alias("n"))
    freq = hits.groupBy("term").agg(F.sum("n").alias("freq"))
    met = hits.join(wanted, "term").join(freq, "term")
    out = met.groupBy("topic", "document_id").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.sum("freq").alias("score"))
    return cap_per_key(out, ["topic"], [F.desc("score"), F.col("document_id")], top) if top else out


def term_sources(units: DataFrame, terms: DataFrame, n: int = 8) -> DataFrame:
    """(term, sources): the first n units of each term of a top list, as document:unit."""
    once = units.select("document_id", "unit_id", F.explode(F.array_distinct(_of(_bounded(terms)))).alias("term"))
    return top_sources(once, ["term"], ["document_id", "unit_id"], n)


def topic_sources(found: DataFrame, units: DataFrame, n: int = 8) -> DataFrame:
    """(topic, sources): the first n units that hold a term of the topic."""
    wanted = found.select("topic", F.explode("terms").alias("term"))
    once = units.select("document_id", "unit_id", F.explode(F.array_distinct(_of(_bounded(wanted)))).alias("term")).join(wanted, "term")
    return top_sources(once, ["topic"], ["document_id", "unit_id"], n)


def key_metrics(records: DataFrame, n: int = 12) -> DataFrame:
    """The first n records of each document in report order."""
    order = [F.col(c).asc_nulls_last() for c in ("entity", "metric", "reporting_period")] + [F.col("record_id")]
    return cap_per_key(records, ["document_id"], order, n)


def document_summary(documents: DataFrame, doc_counts: DataFrame, units: DataFrame, found: DataFrame, top_terms: int = 5, top_topics: int = 3, conflicts: DataFrame | None = None) -> DataFrame:
    """(document_id, summary): counts, what is flagged, pending or (document_id, conflicts) in conflict, main terms of the document and its
    topics, and whether texts were cut before they were counted, as sentences."""
    terms = term_stats(units, min_freq=1, top=top_terms, by=("document_id",))
    order = W.partitionBy("document_id").orderBy(F.desc("freq"), "term")
    terms = terms.withColumn("r", F.row_number().over(order)).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda t: t["term"]), ", ").alias("terms"))
    about = topic_documents(found, units).join(found.select("topic", "label"), "topic")
    about = cap_per_key(about, ["document_id"], [F.desc("score"), F.col("topic")], top_topics).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("topics"))
    cut = units.where("truncated").select("document_id").distinct().withColumn("cut", F.lit(True)) if "truncated" in units.columns else None
    joined = documents.join(doc_counts, "document_id", "left").join(terms, "document_id", "left").join(about, "document_id", "left")
    joined = joined.join(conflicts, "document_id", "left") if conflicts is not None else joined.withColumn("conflicts", F.lit(0))
    joined = joined.join(cut, "document_id", "left") if cut is not None else joined.withColumn("cut", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "document_id",
        F.concat_ws(
            " ",
            F.format_string("%s has %d pages and %d records.", F.coalesce("filename", F.lit("The document")), zero("pages"), zero("records")),
            F.when(zero("flagged") > 0, F.format_string("%d records need review.", zero("flagged"))),
            F.when(zero("pending") > 0, F.format_string("%d records are pending.", zero("pending"))),
            F.when(zero("conflicts") > 0, F.format_string("%d conflicts are open.", zero("conflicts"))),
            F.when(F.col("terms") != "", F.concat(F.lit("Main terms: "), "terms", F.lit("."))),
            F.when(F.col("topics") != "", F.concat(F.lit("Topics: "), "topics", F.lit("."))),
            F.when(F.col("cut"), "Its texts were cut; terms and topics are those of what was read."),
        ).alias("summary"),
    )


def analyze(units: DataFrame, by: str = "corpus") -> dict[str, DataFrame]:
    """Bundle: keywords, cloud and, for a corpus, topics and their documents; by='document' works on all documents at once."""
    keys = ("document_id",) if by == "document" else ()
    terms = term_stats(units, by=keys)
    out = {"keywords": keywords(units, by=keys), "cloud": cloud(terms, by=keys)}
    if not keys:
        out["topics"] = topics(units)
        out["topic_documents"] = topic_documents(out["topics"], units)
    return out
