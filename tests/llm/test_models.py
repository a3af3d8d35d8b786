"""Toxicity, quality, neighbours."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.llm import hilbert, quality, toxicity as X

INSULTS = ["grobulax", "snerfling", "wuzzok"]


def corpus(spark, n=240, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["la", "me", "ti", "or", "an", "es"]) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 40))]
        if i % 4 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_kernel_is_the_gap_weighted_one():
    def slow(a, b):
        def feats(w):
            c, out = X.codes([w])[0], {}
            c = c[c > 0]
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    for k in range(j + 1, min(len(c), i + X.SPAN)):
                        key = (c[i], c[j], c[k])
                        out[key] = out.get(key, 0) + X.DECAY ** (k - i + 1)
            return out

        p, q = feats(a), feats(b)
        return sum(v * q.get(k, 0) for k, v in p.items()) / X.NORMS[len(a) + 2] / X.NORMS[len(b) + 2]

    words = ["idiot", "idxiot", "banana", "a", "aaaaaa"]
    numbers = X._numbers(words)
    f = X._features(words, numbers)
    assert np.allclose(f @ f.T, [[slow(a, b) for b in words] for a in words])


def test_folded_weights_equal_the_landmark_sum():
    model = X.fit_words(INSULTS, ["lame", "orti", "anes", "time", "lala", "mees"], landmarks=6)
    assert (model.margins(INSULTS) > 0.5).all() and (model.margins(["lame", "orti", "anes"]) < 0).all()
    assert model.margins(["grobxulax"])[0] > model.margins(["lametior"])[0] + 0.5


def test_held_out_accuracy_and_gaps(spark):
    docs, labels = corpus(spark)
    model = X.train(docs, labels.where("doc_id % 3 != 0"))
    out = X.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum((r.score >= X.THRESHOLD) == (r.toxic == 1) for r in out) >= 0.97 * len(out)
    odd = [(1, None), (2, ""), (3, "la me g r o b u l a x ti"), (4, "la me grob-ulax ti"), (5, "me ti"), (5, "me ti"), (6, "la" * 5000 + "grobulax" + "me" * 5000), (None, "snerfling")]
    got = X.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    flags = {(r.doc_id, r.score >= X.THRESHOLD) for r in got}
    assert {(1, False), (2, False), (3, True), (4, True), (5, False), (None, True)} <= flags and len(got) == len(odd)
    kept = X.reject(docs, model)
    assert kept.schema == docs.schema and 0.7 * 240 <= kept.count() <= 0.8 * 240


def test_inserted_characters_are_tolerated(spark):
    """Nine in ten of the known insults are flagged with one and with two characters put between their letters, in short texts; clean words
    that are spelt the same way are not."""
    docs, labels = corpus(spark)
    model = X.train(docs, labels)
    pick, rows = random.Random(5), []

    def spelt(word, n):
        for _ in range(n):
            i = pick.randrange(1, len(word))
            word = word[:i] + pick.choice("abcdefghijklmnopqrstuvwxyz") + word[i:]
        return word

    for n in (1, 2):
        for i in range(100):
            rows.append((1000 * n + i, f"la me {spelt(pick.choice(INSULTS), n)} ti or an"))
            rows.append((3000 * n + i, f"la me {spelt(pick.choice(['lametior', 'orortime', 'anesmela']), n)} ti or an"))
    flagged = {r.doc_id for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect() if r.score >= X.THRESHOLD}
    for n in (1, 2):
        assert sum(1000 * n <= i < 1000 * n + 100 for i in flagged) >= 90
        assert sum(3000 * n <= i < 3000 * n + 100 for i in flagged) <= 3


def test_copies_do_not_make_words_toxic(spark):
    docs, labels = corpus(spark)
    copies = spark.range(1000, 1060).select(F.col("id").alias("doc_id"), F.lit("lamelame orororan titiesti wuzzok anesanes").alias("text"), F.lit("").alias("score"))
    model = X.train(docs.unionByName(copies), labels.unionByName(copies.select("doc_id", F.lit(1).alias("toxic"))))
    margins = dict(zip(["wuzzok", "orororan", "titiesti"], model.margins(["wuzzok", "orororan", "titiesti"])))
    assert margins["wuzzok"] > 0.5 and max(margins["orororan"], margins["titiesti"]) < 0.3


def test_nothing_to_learn(spark):
    docs, labels = corpus(spark, 20)
    for some in (labels.where("toxic = 0"), labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r.score for r in X.score(docs, X.train(docs, some)).collect()} == {0.0}
    assert X.score(docs.limit(0), X.Model()).count() == 0


def slow_measures(text):
    words = (text or "").encode().split()
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    gone = [0] * len(words)
    for k, r in enumerate(runs):
        if runs.count(r) > 1:
            gone[k : k + 8] = [1] * 8
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(gone))


@pytest.mark.parametrize("seed", range(5))
def test_measures(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", " ", "\t", "a b c d e f g h "]) for _ in range(rng.randrange(0, 80)))
        assert quality.measure(text)[:5] == slow_measures(text)
    assert quality.measure(None) == quality.measure("") == (0,) * len(quality.MEASURES)
    assert quality.measure(" #\n")[:3] == (1, 1, 1)
    assert quality.repeated_words(np.zeros(100_000, np.int64)) == 100_000


def test_votes_and_posterior(spark):
    good = " ".join(f"word{i} and the other" for i in range(40))
    junk = " ".join(f"w{i}$$$ X{i}***" for i in range(60))
    odd = [(500, None), (501, ""), (502, "one"), (503, good), (503, good)]
    rows = [(i, good.replace("other", f"o{i}")) for i in range(100)] + [(200 + i, junk) for i in range(8)] + odd
    measured = quality.measures(spark.createDataFrame(rows, "doc_id long, text string"))
    out = quality.judge(measured).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r.good for r in out}
    assert all(by[i] for i in range(100)) and not any(by[200 + i] for i in range(8)) and not by[500] and by[503]
    assert quality.judge(measured.limit(0)).count() == 0
    votes = np.array([[1, 1, 1], [2, 2, 1], [0, 0, 0]])
    share, table, p = quality.fit(votes, np.array([900.0, 50.0, 50.0]))
    assert p[0] > 0.9 and p[1] < 0.5 and 0 < share < 1 and np.allclose(table.sum(-1), 1)


@pytest.mark.parametrize("bad_share", [0.15, 0.3])
def test_planted_accuracies_are_recovered(bad_share):
    against = np.array([[0.9, 0.75, 0.6, 0.5, 0.35, 0.2], [0.01, 0.05, 0.02, 0.1, 0.03, 0.08]])  # votes 2 on bad and on good texts
    apart = []
    for n in (3_000, 300_000):
        rng = np.random.default_rng(3)
        good = rng.random(n) >= bad_share
        votes = np.where(rng.random((n, 6)) < against[good.astype(int)], 2, 1)
        patterns, count = np.unique(votes, axis=0, return_counts=True)
        share, table, _ = quality.fit(patterns, count.astype(float))
        apart.append(max(np.abs(table[:, :, 2] - against).max(), abs(share - (1 - bad_share))))
    assert apart[1] < apart[0] and apart[1] < 0.02


def slow_posteriors(rows, rules):
    """Expectation-maximisation text by text, in plain loops."""
    n = len(rows)
    abstain = [min(0.98, max(0.01, sum(v[r] == 0 for v in rows) / n)) for r in range(rules)]
    belief = [[[a, (1 - a) * good, (1 - a) * (1 - good)] for a in abstain] for good in (0.7, 0.997)]
    table, share = belief, 0.85
    judge = lambda v: 1 / (1 + np.exp(-(np.log(share) - np.log(1 - share) + sum(np.log(table[1][r][v[r]]) - np.log(table[0][r][v[r]]) for r in range(rules)))))
    for _ in range(200):
        p = [judge(v) for v in rows]
        table = []
        for c in (0, 1):
            mass = [x if c else 1 - x for x in p]
            votes = [[sum(m for m, v in zip(mass, rows) if v[r] == k) + quality.PRIOR * belief[c][r][k] for k in range(3)] for r in range(rules)]
            table.append([[x / sum(row) for x in row] for row in votes])
        share = (sum(p) + 0.85 * quality.PRIOR) / (n + quality.PRIOR)
    return [judge(v) for v in rows]


def test_posterior_of_every_text_by_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        bad = rng.random() < 0.3
        one = 2 if rng.random() < (0.8 if bad else 0.02) else 1
        rows.append((i, one, one if rng.random() < 0.95 else 1, 2 if rng.random() < (0.6 if bad else 0.05) else rng.choice([0, 1]), 2 if rng.random() < (0.4 if bad else 0.1) else 1))
    rules = [quality.Rule(f"r{k}", F.col(f"v{k}") == 1, F.col(f"v{k}") == 2) for k in range(4)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, v0 int, v1 int, v2 int, v3 int"), rules).orderBy("doc_id").collect()
    want = slow_posteriors([r[1:] for r in rows], 4)
    assert np.allclose([r.quality for r in out], want, atol=1e-6)
    assert [r.good for r in out] == [p >= 0.5 for p in want] and 0 < sum(r.good for r in out) < 160


def test_rules_that_always_agree_share_their_votes():
    rng = np.random.default_rng(6)
    one, other = (np.where(rng.random(20_000) < rate, 2, 1) for rate in (0.3, 0.1))
    for copies in (1, 3):
        votes, count = np.unique(np.c_[np.repeat(one[:, None], copies, 1), other], axis=0, return_counts=True)
        weight = quality.rule_weights(votes, count.astype(float), np.full(len(votes), 0.5))
        assert np.allclose(weight[:copies], 1 / copies, atol=0.03) and weight[copies] > 0.95
        assert np.isfinite(quality.fit(votes, count.astype(float), share_votes=True)[2]).all()
    few, many = (quality.rule_weights(np.array([[2, 2], [1, 1]]), np.array([n, 10.0 * n]), np.full(2, 0.5)) for n in (2, 20_000))
    assert few[0] > 0.85 and many[0] < 0.51


def slow_neighbours(rows, queries, k):
    out = []
    for q in queries:
        s = []
        for v, x in rows.items():
            if v != q:
                a, b = np.array(rows[q], float)[None], np.array(x, float)[None]
                s.append((-hilbert.cosine(a, b)[0], v))
        out += [(q, n, v, -c) for n, (c, v) in enumerate(sorted(s)[:k], 1)]
    return sorted(out)


def test_hilbert_curve():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(hilbert.hilbert_index(cells, 3))
    assert sorted(hilbert.hilbert_index(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_neighbours_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = {i: [float(np.float32(x)) for x in rng.standard_normal(8)] for i in range(400)}
    for i in range(100, 180):
        rows[i] = rows[100]  # copies: ties go to the smaller id
    data = [(i, v, "x") for i, v in rows.items()] + [(1000, None, ""), (1001, [0.0] * 8, ""), (1002, [float("nan")] * 8, ""), (1003, [1.0] * 7, ""), (1004, [None] * 8, ""), (None, [1.0] * 8, ""), (3, rows[3], "x")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, key string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in hilbert.nearest(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == slow_neighbours(rows, [i for i in rows if i % 20 == 0], 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(hilbert, "ROW_BLOCK", 16), monkeypatch.setattr(hilbert, "QUERY_BLOCK", 3), monkeypatch.setattr(hilbert, "FAN", 4), monkeypatch.setattr(hilbert, "WINDOW", 4)
    try:  # many blocks, sorted joins
        again = hilbert.nearest(frame, F.col("vec_id") % 20 == 0)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in again.collect()) == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = frame.where("vec_id in (0, 1, 2)")
    assert [(r.query_id, r.vec_id) for r in hilbert.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()][0][0] == 0
    assert hilbert.nearest(few, F.col("vec_id") == 0).count() == 2 and hilbert.nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0
    loose = hilbert.nearest(frame, F.col("vec_id") % 20 == 0, exact=False)
    assert loose.columns == ["query_id", "rank", "vec_id", "score"]


def test_fitting_holds_no_dense_features_of_all_words():
    rng = random.Random(3)
    words = list(dict.fromkeys("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 14))) for _ in range(3000)))
    numbers = X._numbers(words[:40])
    dense, (row, number, value) = X._features(words[:40], numbers), X._placed(words[:40])
    sparse = np.zeros_like(dense)
    sparse[row, np.searchsorted(numbers, number)] = value
    assert np.allclose(dense, sparse) and len(value) == np.count_nonzero(dense)
    tracemalloc.start()
    marks = X._landmarks(words, 20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(marks)) == 20 and most < 60e6  # 3,000 rows of some 17,000 subsequences are 200 MB in single precision
