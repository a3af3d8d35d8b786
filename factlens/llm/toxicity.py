"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel: the gap-weighted subsequence kernel. Every three characters that stand in order within `SPAN` places of a token
are one feature, of weight `DECAY` to the power of the places they span, so a spelling with gaps or inserted characters
still shares most of the mass of the plain one. Values are divided by what a token of that length can reach at most.

Training is multiple-instance: a labelled text is the bag, the tokens of its sentences are the instances, and the machine learns which
of them make it toxic. On a bounded sample of labelled rows Spark counts in how many toxic and clean texts each token stands; tokens
bound to toxic texts (likelihood ratio, hardly any clean text) are the first positive instances, tokens of clean texts the negative ones.
Each further round looks at what decides the texts of the sample: a token that decides clean texts too becomes a negative instance, a positive one
included, and a toxic text without a token that speaks for it gives the one most bound to toxic texts as a new positive instance. The surest
instances also stand there in spellings with one and two inserted letters, weighed apart, so that the machine keeps the mass that such spellings share. A phrase of
ordinary words is not learnt, since instances are single tokens. Landmarks span the Nyström feature space, in which
a linear machine with squared hinge is fitted. The sum over landmarks is linear in the subsequences of a token, so it is
folded, without loss, into one weight per subsequence before the corpus is scored.

A text scores by its highest token, by how many of its tokens speak for the label and by how many it has, through a logistic curve
fitted on the sample: a token that toxic texts use often and clean ones now and then needs company, a plain insult does not. Labels, language, source and id are
no inputs of a score. Null and empty texts have no token and score as the curve says for the bias alone. Without any toxic
or any clean label nothing can be learnt: every score is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, materialize

SPAN, DECAY, LENGTH, SYMBOLS = 6, 0.6, 24, 64
THRESHOLD = 0.3
#: A token of a higher margin speaks for the label.
SPEAKS = 0.5
#: Beyond this margin a token hardly needs company.
SURE = 1.25
#: Share of a word's margin that its spellings with inserted letters are to have.
DISGUISED = 0.9
#: Letters spelt out one by one ("a b c d"), which are read as one token as well.
SPELT = re.compile(r"(?<!\S)\S(?:[ \t]\S(?!\S)){2,}")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Places of the second and third character behind the first one.
GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def _code(c: str) -> int:
    n = ord(c)
    if 97 <= n <= 122:
        return n - 96
    if 48 <= n <= 57:
        return n - 48 + 27
    return 37 + n % 25


class _Codes(dict):
    def __missing__(self, n: int) -> int:
        self[n] = out = _code(chr(n))
        return out


CODES = _Codes()


def tokens(text: str | None) -> set[str]:
    """The distinct tokens of a text: words in lower case without outer punctuation, those with inner punctuation also
    without it, letters spelt out, and long words in overlapping pieces, so that no part of a text is left out."""
    if not text:
        return set()
    low = text.lower()
    found = {w.strip(EDGES) for w in low.split()}
    if " " in low:
        found.update(re.sub(r"\s", "", m) for m in SPELT.findall(low))
    found.update([re.sub(r"[\W_]", "", w) for w in found if not w.isalnum()])
    for w in [w for w in found if len(w) > LENGTH]:
        found.discard(w)
        found.update(w[i : i + LENGTH] for i in range(0, max(1, len(w) - LENGTH // 2), LENGTH // 2))
    found.discard("")
    return found


def codes(words: list[str]) -> np.ndarray:
    """Words as rows of symbol numbers between a begin and an end mark, 0 behind the end."""
    out = np.zeros((len(words), LENGTH + 2), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w) + 2] = [62, *[CODES[ord(c)] for c in w], 63]
    return out


def _norms() -> np.ndarray:
    out = np.ones(LENGTH + 3)
    for n in range(3, LENGTH + 3):
        out[n] = np.sqrt(sum(DECAY ** (2 * (k + 1)) for i in range(n) for _, k in GAPS if i + k < n))
    return out


NORMS = _norms()


def subsequences(rows: np.ndarray):
    """Yield (row numbers, feature numbers, weight) of every placement of three characters."""
    for i in range(rows.shape[1] - 2):
        alive = np.flatnonzero(rows[:, i + 2])
        if not len(alive):
            return
        part = rows[alive]
        for j, k in GAPS:
            if i + k < rows.shape[1]:
                last = part[:, i + k]
                yield alive, np.where(last > 0, part[:, i] * SYMBOLS * SYMBOLS + part[:, i + j] * SYMBOLS + last, 0), DECAY ** (k + 1)


@dataclass
class Model:
    """weights: one for each subsequence, 0 at number 0; curve: weights of what a text shows, the constant last. None where nothing was
    learnt."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    curve: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0)
    landmarks: list[str] = field(default_factory=list)

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in range(0, len(words), 20000):
            rows = codes(words[at : at + 20000])
            total = np.zeros(len(rows))
            for alive, number, weight in subsequences(rows):
                total[alive] += weight * self.weights[number]
            out[at : at + 20000] = total / NORMS[(rows > 0).sum(1)] + self.bias
        return out

    def probability(self, shown: np.ndarray) -> np.ndarray:
        """Of rows (highest margin, tokens that speak for it, tokens)."""
        if self.weights is None:
            return np.zeros(len(shown))
        return 1 / (1 + np.exp(-np.clip(_signs(shown) @ np.array(self.curve), -500, 500)))


def _signs(shown: np.ndarray) -> np.ndarray:
    """What the curve weighs: the highest margin, what of it is beyond SURE, and the logarithms of how many tokens speak for it and of how
    many there are."""
    return np.c_[shown[:, 0], np.maximum(0, shown[:, 0] - SURE), np.log1p(shown[:, 1]), np.log1p(shown[:, 2]), np.ones(len(shown))]


def _features(words: list[str], numbers: np.ndarray) -> np.ndarray:
    """Dense kernel features of words, over the given subsequences only (sorted numbers)."""
    place = np.full(SYMBOLS**3, -1, np.int64)
    place[numbers] = np.arange(len(numbers))
    rows, out = codes(words), np.zeros((len(words), len(numbers)))
    for alive, number, weight in subsequences(rows):
        at = place[number]
        ok = at >= 0
        out[alive[ok], at[ok]] += weight  # a row has one placement in each step
    out /= NORMS[(rows > 0).sum(1)][:, None]
    return out


def _numbers(words: list[str]) -> np.ndarray:
    found = np.unique(np.concatenate([n for _, n, _ in subsequences(codes(words))] or [np.zeros(0, np.int64)]))
    return found[found > 0]


def _placed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel features of words as (row, number, value), without zeros: a word has some hundred of SYMBOLS**3."""
    rows = codes(words)
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for alive, number, weight in subsequences(rows):
        ok = number > 0
        keys.append(alive[ok] * SYMBOLS**3 + number[ok])
        weights.append(np.full(len(keys[-1]), weight))
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    row = keys // SYMBOLS**3
    return row, keys % SYMBOLS**3, np.bincount(at, np.concatenate(weights), len(keys)) / NORMS[(rows > 0).sum(1)][row]


def _landmarks(words: list[str], count: int) -> list[str]:
    """Greedy farthest-first choice in kernel space."""
    if len(words) <= count:
        return list(words)
    row, number, value = _placed(words)
    start = np.searchsorted(row, np.arange(len(words) + 1))
    square = np.bincount(row, value * value, len(words))
    chosen, far, one = [0], np.full(len(words), np.inf), np.zeros(SYMBOLS**3)
    while len(chosen) < count:
        c = chosen[-1]
        own = slice(start[c], start[c + 1])
        one[number[own]] = value[own]
        far = np.minimum(far, square + square[c] - 2 * np.bincount(row, value * one[number], len(words)))
        one[number[own]] = 0
        chosen.append(int(far.argmax()))
    return [words[i] for i in dict.fromkeys(chosen)]


def _fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, reach: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps, each instance to its own margin; the last column of x is 1, the last weight the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        slack = reach - y * (x @ w)
        on = slack > 0
        gradient, hessian = penalty * w, np.diag(penalty)
        for at in range(0, len(x), 1000):  # no second copy of all instances
            part = at + np.flatnonzero(on[at : at + 1000])
            xs, cs = x[part], cost[part]
            gradient -= 2 * xs.T @ (cs * y[part] * slack[part])
            hessian += 2 * (xs * cs[:, None]).T @ xs
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_words(positive: list[str], negative: list[str], landmarks: int = 192, cost: float = 1.0, pool: int = 3000, reach: dict[str, float] | None = None, spelt: list[str] | None = None) -> Model:
    """The machine for given instances: landmarks (two thirds positive, the others from the first `pool` negative ones), Nyström map,
    weights folded into subsequences. All instances are fitted; reach: margins that positive ones are to have, 1 where none is given;
    spelt: disguised spellings of positive ones."""
    plain, positive = len(positive), positive + (spelt or [])
    n = landmarks * 2 // 3
    marks = _landmarks(positive[: plain + 300], n)  # the first disguised ones are of the surest words
    marks += [w for w in _landmarks(negative[:pool], landmarks - n) if w not in set(marks)]
    numbers = _numbers(marks)
    z = _features(marks, numbers)
    values, vectors = np.linalg.eigh(z @ z.T)
    good = values > 1e-9 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    words = positive + negative
    x = np.ones((len(words), whiten.shape[1] + 1))
    for i in range(0, len(words), 250):
        x[i : i + 250, :-1] = (_features(words[i : i + 250], numbers) @ z.T) @ whiten
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    # Disguised spellings weigh together what the words themselves do, however many they are.
    weight = cost * (plain + len(negative)) / 2
    each = np.r_[np.full(plain, weight / plain), np.full(len(positive) - plain, weight / max(1, len(positive) - plain)), np.full(len(negative), weight / max(1, len(negative)) * 2)]
    wanted = np.r_[[(reach or {}).get(p, 1.0) for p in positive], np.ones(len(negative))]
    w = _fit_svm(x, y, each, wanted)
    table = np.zeros(SYMBOLS**3)
    table[numbers] = z.T @ (whiten @ w[:-1])
    return Model(table, float(w[-1]), landmarks=marks)


def _fit_curve(shown: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """A logistic curve by Newton steps, with Platt's smoothed targets and a light ridge."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = _signs(shown)
    w = np.zeros(x.shape[1])
    ridge = np.array([0.1] * (len(w) - 1) + [1e-4])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - target) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _scorer(model: Model, keep: int = 300_000):
    """Texts -> (rows of what Model.probability takes, the token of the highest margin); margins of tokens are kept up to a bound, those
    of a batch computed at once."""
    known: dict[str, float] = {}

    def run(texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        shown, why = np.zeros((len(texts), 3)), [None] * len(texts)
        if model.weights is None:
            return shown, why
        shown[:, 0] = model.bias
        for at in range(0, len(texts), 500):
            bags = [tokens(t) for t in texts[at : at + 500]]
            new = list(set().union(*bags).difference(known))
            if len(known) + len(new) > keep:
                known.clear()
                new = list(set().union(*bags))
            known.update(zip(new, model.margins(new).tolist()))
            for i, bag in enumerate(bags, at):
                if bag:
                    margins = list(map(known.__getitem__, bag))
                    top = max(margins)
                    # Of equal ones the first in order, so that reruns name the same.
                    why[i] = min(w for w, m in zip(bag, margins) if m == top)
                    shown[i] = top, sum(m > SPEAKS for m in margins), len(bag)
        return shown, why

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, margin, speaking, tokens, token) of every row: the highest margin, how many distinct tokens speak for the label, how many
    there are, and the one of the highest margin."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SYMBOLS and the number of landmarks

    def run(batches):
        scorer = _scorer(shared.value)
        for b in batches:
            shown, why = scorer(b.column(1).to_pylist())
            columns = [pa.array(shown[:, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.probability(shown)), *columns, pa.array(why, pa.string())], ["id", "score", "margin", "speaking", "tokens", "token"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, score double, margin double, speaking double, tokens double, token string").withColumnRenamed("id", id_col)


def _counts(sample: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many texts of either label a token stands, or between how many different pairs of neighbours if
    these are fewer, since the words of a much copied text would else look bound to its label, as would one that a text repeats."""

    def run(batches):
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [w.strip(EDGES) for w in (text or "").lower().split()]
                around = {(w, xxhash.xxh64_intdigest(f"{before} {after}") >> 1) for before, w, after in zip(["", *words], words, [*words[1:], ""]) if 0 < len(w) <= LENGTH}
                found = list(around | {(w, 0) for w in tokens(text).difference(words)})
                seen, first = set(), []
                for w, _ in found:
                    first.append(w not in seen)
                    seen.add(w)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([h for _, h in found], pa.int64()), pa.array([label] * len(found), pa.int32()), pa.array(first, pa.bool_())], ["token", "around", "label", "first"])

    each = sample.select("text", "label").mapInArrow(run, "token string, around long, label int, first boolean")
    toxic = F.col("label") == 1
    placed = each.groupBy("token", "around").agg(F.max("label").alias("label"), F.count_if(toxic & F.col("first")).alias("t"), F.count_if(~toxic & F.col("first")).alias("c"))
    both = placed.groupBy("token").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    return both.select("token", F.least("toxic", "t").alias("toxic"), F.least("clean", "c").alias("clean"))


def _reach(toxic: int, clean: int) -> float:
    """The margin a positive instance is to have: the surer it is, by the logarithm of its odds, the more, within bounds."""
    return float(np.clip(np.log((toxic + 0.5) / (clean + 0.5)) / 3, 0.7, 2.0))


def _strongest(sample: DataFrame, rows: list[int], rated: DataFrame) -> dict[str, float]:
    """The token with the highest ratio of each of these rows of the sample, of those that are rated at all, with its margin to reach."""

    def run(batches):
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [w for w in tokens(text) if len(w) <= LENGTH]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(found, pa.string())], ["row", "token"])

    wanted = sample.sparkSession.createDataFrame([(r,) for r in rows], "row long")
    met = sample.join(F.broadcast(wanted), "row").select("row", "text").mapInArrow(run, "row long, token string").join(rated, "token")
    best = met.groupBy("row").agg(F.max(F.struct("ratio", "token", "toxic", "clean")).alias("m")).select("m.*").distinct()
    return {r["token"]: _reach(r["toxic"], r["clean"]) for r in best.orderBy("token").collect()}


def disguises(word: str, each: int = 16) -> list[str]:
    """Spellings of a word with one and with two inserted letters, `each` of both where it has the places: the letters and places go by its hash, so that
    reruns give the same. Insertions stand between letters, as those before and behind the word keep it whole."""
    out: dict[str, None] = {}
    places = list(range(1, len(word)))
    for k in range(2 * each):
        h = xxhash.xxh64_intdigest(f"{word} {k}")
        spelt = word
        for i in sorted({places[(h >> 8 * j) % len(places)] for j in range(1 + k % 2)}, reverse=True):
            spelt = spelt[:i] + chr(97 + (h >> (32 + i)) % 26) + spelt[i:]
        if len(spelt) <= LENGTH:
            out[spelt] = None
    return list(out)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 3000, max_clean: int = 6000, max_positive: int = 1500, max_negative: int = 8000, rounds: int = 4, purity: float = 4.0, max_disguised: int = 150) -> Model:
    """Fit on at most `max_toxic` and `max_clean` labelled texts, those of least hashed id; repeated labels of an id count once, the toxic one first.

    A positive instance stands for `purity` toxic texts to one clean text at least. What reaches the driver is bounded by these parameters: tokens, and
    one margin for each text of the sample. Where no token is surely bound to toxic texts the ten most bound ones begin.
    """
    spark = docs.sparkSession
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    one = one.withColumn("h", F.xxhash64("id"))
    ids = one.where("label = 1").orderBy("h", "id").limit(max_toxic).unionByName(one.where("label = 0").orderBy("h", "id").limit(max_clean)).select("id", "label")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = materialize(texts.join(F.broadcast(ids), "id").select("text", "label").repartition(24).withColumn("row", F.monotonically_increasing_id()), "labelled")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    counts = materialize(_counts(sample), "tokens")
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n1, n0 = max(1, total[0] or 0), max(1, total[1] or 0)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (a + b) / (n1 + n0)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (term(a, n1 * share) + term(b, n0 * share) + term(n1 - a, n1 * (1 - share)) + term(n0 - b, n0 * (1 - share)))
    pure = counts.withColumn("ratio", F.when(a / n1 > b / n0, ratio).otherwise(0.0)).where((F.col("ratio") > 0) & (purity * b <= a))
    top = pure.orderBy(F.desc("ratio"), "token").limit(max_positive).collect()
    positive = [r["token"] for r in top if r["ratio"] > 15] or [r["token"] for r in top[:10]]
    if not positive:
        return Model()
    reach = {r["token"]: _reach(r["toxic"], r["clean"]) for r in top}
    plain = counts.where(F.col("clean") > 0).join(F.broadcast(spark.createDataFrame([(w,) for w in positive], "token string")), "token", "left_anti")
    half = max_negative // 2
    frequent = [r["token"] for r in plain.orderBy(F.desc("clean"), "token").limit(half).collect()]
    others = [r["token"] for r in plain.orderBy(F.xxhash64("token"), "token").limit(half).collect()]
    negative = list(dict.fromkeys(frequent + others))
    for last in range(rounds):
        # The surest instances stand there with inserted letters too, unless a clean text uses such a spelling as a word.
        known = set(negative)
        sure = sorted((w for w in positive if reach.get(w, 0) >= SURE and 4 <= len(w) <= LENGTH - 2), key=lambda w: (-reach[w], w))[:max_disguised]
        spelt = {v: DISGUISED * reach[w] for w in sure for v in disguises(w) if v not in known}
        model = fit_words(positive, negative, landmarks=256, reach=spelt | reach, spelt=[v for v in spelt if v not in set(positive)])
        seen = score(sample.select(F.col("row").alias("doc_id"), "text"), model).withColumnRenamed("doc_id", "row").join(sample.select("row", "label"), "row").select("row", "label", "margin", "speaking", "tokens", "token").toPandas()
        if last == rounds - 1:
            break
        deciding = seen[(seen.margin > -0.5) & seen.token.notna()].groupby("token").label.agg(["sum", "count"])
        wrong = set(deciding.index[purity * (deciding["count"] - deciding["sum"]) > deciding["sum"]])
        negative += sorted(wrong.difference(negative))
        dull = seen[(seen.label == 1) & ((seen.margin < 0) | seen.token.isin(wrong))].row.tolist()
        # A token that only one context binds to toxic texts may stand there by chance.
        new = _strongest(sample, dull, pure.where("toxic >= 2 and ratio > 6"))
        known = set(negative)
        reach = new | reach
        positive = [w for w in dict.fromkeys([*positive, *new]) if w not in known][:max_positive]
        if not positive:
            return Model()
    model.curve = _fit_curve(seen[["margin", "speaking", "tokens"]].to_numpy(), seen.label.to_numpy().astype(float))
    discard(counts)
    discard(sample)
    return model


def trainable(col) -> F.Column:
    """Whether an id is no held-out one: crc32 of its text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def train_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.where(trainable(F.col("doc_id"))))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns, in one pass over their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        scorer = _scorer(shared.value)
        for b in batches:
            shown, _ = scorer(b.column(place).to_pylist())
            yield b.filter(pa.array(shared.value.probability(shown) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document scored; labels are learnt from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_tables(spark, docs, sf_dir)
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        (~trainable(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "token",
    )
