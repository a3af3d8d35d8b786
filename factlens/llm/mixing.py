"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources share `share` times all words by weight, none above `most` times its own size; what is above is shared
again by weight until none is (water-filling). Each document is then taken whole as often as the target asks: the whole
part of target / size for all documents, the remaining part for those that come first in a random but fixed order of their
source, the last of them in part. Positions: a weight schedule of a source is a piecewise-linear function of training time;
its integral, scaled to the words taken, is the demand up to that time. Every pass over a document has its own place in the words taken
(the passes before it, then the documents before it), and inverting the demand there gives that pass its position in [0, 1].
Range-sorting all passes by position is the training order.

Rows that agree in id, source, size (and, where texts are kept, text) are one entry with a number of copies. Running sums inside a source are taken on
two levels, over hash buckets and inside a bucket; buckets grow with the rows, so a source with a third of them stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize

#: About how many entries of a source are summed up in one group.
BUCKET_ROWS = 50_000
WEIGHTS = (5.0, 2.0, 1.0)
#: Weight against time, as (time, factor) points; sources take these in turn: constant, fading, rising.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0. Counted as starts of words, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, weight, target) of a frame with source, size and, optionally, copies; one row a source, null being one.

    Sources are numbered in code point order, null last, by a distributed sort; their weights repeat. A source without
    words has target 0. The level is found by Newton's steps on a concave function of the weights, a handful of small jobs.
    """
    spark = sized.sparkSession
    words = F.col("size") * F.col("copies") if "copies" in sized.columns else F.col("size")
    totals = sized.groupBy("source").agg(F.sum(words).alias("source_size"))
    order = totals.orderBy(F.col("source").asc_nulls_last())
    numbered = spark.createDataFrame(order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "source string, source_size long, n long")
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")))
    weighed = materialize(weighed.withColumn("cap", most * F.col("source_size")).where("source_size is not null"), "sources")
    budget = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = None, -1
    while True:  # each round at least one more source is full
        above = F.lit(False) if level is None else F.col("weight") * level > F.col("cap")
        row = weighed.agg(F.sum(F.when(above, F.col("cap"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("full")).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (budget - (row["held"] or 0.0)) / row["open"]
    target = F.col("cap") if level is None else F.least("cap", F.col("weight") * level)
    return weighed.select("source", "source_size", "n", "weight", target.alias("target"))


def _invert(schedule: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time by which `share` (0 to 1) of the integral of a piecewise-linear schedule has passed."""
    areas, total = [], 0.0
    for (t0, a), (t1, b) in zip(schedule, schedule[1:]):
        areas.append((total, t0, t1, a, b))
        total += (a + b) / 2 * (t1 - t0)
    out = F.lit(1.0)
    for done, t0, t1, a, b in reversed(areas):
        slope = (b - a) / (t1 - t0)
        rest = share * total - done
        x = rest / a if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * rest)) - a) / slope
        out = F.when(rest <= (a + b) / 2 * (t1 - t0), t0 + x).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def _entries(docs: DataFrame, key: Column, weights, share: float, most: float, schedules, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, key, copies, source_size, target, passes, part, positions): entries with what the mix takes of them. Of every
    copy `passes` whole ones are taken, and `part` words of all copies together; positions are those of the passes, the one in part last."""
    order = F.md5(F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit(""))))
    one = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    sized = materialize(one.groupBy("id", "source", "size", "key").agg(F.count("*").alias("copies")).withColumn("h", order), "sized")
    table = sources(sized, weights, share, most)
    digits = 1
    while 16**digits * BUCKET_ROWS < sized.count():
        digits += 1
    placed = sized.withColumn("b", F.substring("h", 1, digits)).withColumn("all", F.col("size") * F.col("copies"))
    sums = placed.groupBy("source", "b").agg(F.sum("all").alias("s"))
    sums = sums.withColumn("before", F.sum("s").over(W.partitionBy("source").orderBy("b")) - F.col("s")).drop("s")
    inside = F.sum("all").over(W.partitionBy("source", "b").orderBy("h", "id", "size", "key").rowsBetween(W.unboundedPreceding, W.currentRow))
    running = placed.withColumn("inside", inside).alias("p")
    joined = running.join(sums.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.b") == F.col("s.b")))
    joined = joined.join(table.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    words = F.floor("target")
    start = F.col("s.before") + F.col("p.inside") - F.col("all")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    # What a whole number of passes over the source leaves of the target goes to the documents that come first.
    part = F.greatest(F.lit(0), F.least(F.col("all"), words - passes * F.col("source_size") - start))
    flat = joined.select("id", "p.source", "size", "key", "copies", "n", "source_size", "target", start.alias("start"), words.alias("words"), passes.alias("passes"), part.alias("part"))
    number = F.when(F.col("size") > 0, F.col("passes") + (F.col("part") > 0).cast("long")).otherwise(0)

    def position(j: Column) -> Column:
        done = (j * F.col("source_size") + F.col("start")) / F.col("words")
        return F.coalesce(*[F.when(F.col("n") % len(schedules) == k, _invert(s, F.least(F.lit(1.0), done))) for k, s in enumerate(schedules)])

    positions = F.when(number > 0, F.transform(F.sequence(F.lit(0).cast("long"), number - 1), position)).otherwise(F.array().cast("array<double>"))
    return flat.withColumn("positions", positions).drop("n", "start", "words")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, positions (one a pass, that in part last; empty if nothing is taken).

    Null and empty texts have size 0 and are never taken. Ties in the order are broken by id and size.
    """
    entries = _entries(docs, F.lit(0), weights, share, most, schedules, id_col, text_col, source_col)
    each = entries.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    own = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("copy") * F.col("size")))
    passes = F.when(own > 0, F.col("positions")).otherwise(F.slice("positions", F.lit(1), F.greatest(F.col("passes").cast("int"), F.lit(0))))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("passes") * F.col("size") + own).cast("long").alias("taken"), passes.alias("positions"))


def apply(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus, range-sorted by position, with the columns of the input: a row for every pass over a document.

    Texts stay whole, so the pass in part, one document a source, is there if it takes half of the document or more; a source is
    off its target by half a document at most. Documents without words are kept once, in the middle of training, for no mix decides on them.
    """
    text_key = F.xxhash64(text_col)
    entries = _entries(docs, text_key, weights, share, most, schedules, id_col, text_col, source_col)
    whole = F.when(2 * F.col("part") >= F.col("size") * F.col("copies"), F.col("positions")).otherwise(F.slice("positions", F.lit(1), F.greatest(F.col("passes").cast("int"), F.lit(0))))
    at = entries.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("key").alias("__key"), F.when(F.col("size") > 0, whole).otherwise(F.array(F.lit(0.5))).alias("__at")).where(F.size("__at") > 0)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (text_key == F.col("__key"))
    passes = docs.join(at, same).withColumn("__position", F.explode("__at"))
    return passes.repartitionByRange(F.col("__position"), F.xxhash64(id_col)).sortWithinPartitions("__position", id_col).select(*docs.columns)


def op10_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """Contract query: documents, weights 5, 2, 1, 150 % of all words, twice a source at most; positions of the first and the last pass."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("position"), F.try_element_at("positions", F.lit(-1)).alias("last_position"))


def _oracle() -> str:
    def at(done: str) -> str:
        return f"""least(1.0, greatest(0.0, CASE n % 3 WHEN 0 THEN {done}
            WHEN 1 THEN (sqrt(greatest(0.0, 2.25 - 2 * {done})) - 1.5) / -1.0 ELSE (sqrt(greatest(0.0, 0.25 + 2 * {done})) - 0.5) / 1.0 END))"""

    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS budget FROM totals),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, n, least(cap, weight * coalesce((SELECT max(level) FROM levels WHERE weight * level <= cap), 1e300)) AS target FROM weighed),
ends AS (
  SELECT s.*, t.source_size, t.target, t.n, floor(t.target) AS words,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS finish
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(words / source_size) ELSE 0 END AS passes FROM ends),
takes AS (
  SELECT *, greatest(0, least(size, words - passes * source_size - (finish - size))) AS part FROM parts),
shown AS (
  SELECT *, (passes * size + part)::BIGINT AS taken, passes + (part > 0)::INT AS n_passes,
         (finish - size) / words AS done, ((passes + (part > 0)::INT - 1) * source_size + finish - size) / words AS last_done FROM takes)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN {at("least(1.0, done)")} END AS position,
       CASE WHEN taken > 0 THEN {at("least(1.0, last_done)")} END AS last_position
FROM shown
"""


ORACLE = _oracle()
