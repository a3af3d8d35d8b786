"""Collocations against plain counting."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from factlens.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, least, top=2000):
    """By the words of the contract: every phrase counted, every longer candidate looked into."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    candidates = [(x, p) for (x, p), a in f.items() if len(p) > 1 and a >= least]
    inside = Counter()
    for x, q in candidates:
        for i in range(len(q)):
            for j in range(i + 2, len(q) + 1):
                if j - i < len(q):
                    inside[x, q[i:j]] = max(inside[x, q[i:j]], f[x, q])
    out = []
    for x, p in candidates:
        a = f[x, p]
        if inside[x, p] < a:
            score, k = min((1000 * a * n[x] // (f[x, p[:k]] * f[x, p[k:]]), k) for k in range(1, len(p)))
            out.append((x, -score, -a, " ".join(p).encode(), f[x, p[:k]], f[x, p[k:]], n[x]))
    ranks, rows = Counter(), []
    for x, score, a, phrase, l, r, total in sorted(out):
        ranks[x] += 1
        if ranks[x] <= top:
            rows.append((x, ranks[x], phrase.decode(), -a, l, r, total, -score))
    return rows


def run(spark, rows, **how):
    docs = spark.createDataFrame([(t, x, i, "clash", 1) for i, (t, x) in enumerate(rows)], "text string, lang string, doc_id long, gram string, n int").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(docs, **how).collect())


def test_counts_of_repeated_pieces_nulls_and_overlaps(spark):
    rows = [("a b c d e f g. a b c", "en"), ("A B C D E F G!", "en"), ("b b b b b b b", None), (None, "en"), ("", None), ("é é é é x, é é", "fr"), ("a b\tc\x0bd e", "en"), ("a b c d e f g", "en"), ("x" * 5000 + " y " + "x" * 5000 + " y", "und")]
    for least in (1, 2, 3):
        assert run(spark, rows, least=least, bits=16) == plain(rows, least)
    assert run(spark, rows * 2, least=2, bits=16, top=3) == plain(rows * 2, 2, 3)


def test_a_small_filter_and_a_hot_phrase_change_nothing(spark, monkeypatch):
    rows = [(f"the hot pair w{i % 7} w{i % 3} goes on and on. w{i}", "en" if i % 3 else "de") for i in range(300)]
    want = plain(rows, 20)
    assert run(spark, rows, least=20, bits=16) == want
    assert run(spark, rows, least=20, bits=4) == want
    assert want


def test_runs_of_frequent_pairs_that_are_rare_themselves_are_no_rows_of_their_own(spark):
    # Every pair of neighbours occurs often, hardly any triple: what is handed on is cut where a run can't be frequent.
    rows = [(" ".join(f"w{(i * 7 + j * j * (i + 3)) % 11}" for j in range(40)), "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    pairs = Counter(p for text, _ in rows for p in zip(text.split(), text.split()[1:]))
    longer = {k: Counter(p for text, _ in rows for p in zip(*[text.split()[i:] for i in range(k)])) for k in (3, 4, 5)}
    least = min(pairs.values())
    made = [(r["k"], tuple(r["gram"].split())) for r in phrases.graph(docs, least, bits=20).where("k > 2").collect()]
    assert least >= 20 and sum(n < least for n in longer[5].values()) > 50
    assert all(longer[k][gram] >= least for k, gram in made)
    assert run(spark, rows, least=least, bits=20) == plain(rows, least)


def test_more_splits_hand_on_no_more_rows(spark):
    # What a task hands on is summed over all its splits, so partial sums don't grow with splits times frequent runs.
    rows = [(f"the same few words go on w{i % 3}", "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(60)
    assert phrases._texts(docs, "lang", "text").rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    found = sorted(tuple(r) for r in phrases.collocations(docs, 20, bits=16).collect())
    assert found == plain(rows, 20) and found


def test_empty_tables_have_no_phrases(spark):
    assert run(spark, [], bits=8) == []
    assert run(spark, [(None, None), ("...", "en")], bits=8) == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("ab. ,\n", max_size=40), st.sampled_from(["en", None])), max_size=12), st.integers(1, 4))
def test_any_text_counts_as_plain_counting_does(spark, rows, least):
    assert run(spark, rows, least=least, bits=10) == plain(rows, least)


def test_unary_paths_spell_shared_passages(spark):
    passage = [f"p{i}" for i in range(40)]
    rows = [(" ".join(passage), "en")] * 4 + [(" ".join(["x", *passage[:20], "y"]), "en")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = {(r["path"], r["n_words"], r["n"]) for r in phrases.paths(phrases.levels(phrases.graph(docs, 3, bits=12)), 3).collect()}
    assert found == {
        (" ".join(passage[:20]), 20, 7),
        (" ".join(passage[16:]), 24, 4),
        (" ".join(["x", *passage[:4]]), 5, 3),
        (" ".join([*passage[16:20], "y"]), 5, 3),
    }


@pytest.mark.parametrize("big", [10**15])
def test_products_beyond_64_bits_are_exact(spark, big):
    score = "(cast({0} as decimal(17,0)) * cast({0} as decimal(17,0)) * 1000BD) div (cast({1} as decimal(18,0)) * cast({1} as decimal(18,0)))"
    assert spark.sql("select " + score.format(f"{big}L", f"{big - 1}L") + " as s").first()["s"] == 1000 * big * big // (big - 1) ** 2
