"""Language by nearest centroid: counts by brute force, held-out accuracy, rejection."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from factlens.llm import language

DATA = "/root/testdata/sf0.01"
WORDS = {"en": "the quick brown fox jumps over lazy dogs while others wait with them", "de": "der schnelle braune fuchs springt über faule hunde während andere warten", "el": "η γρήγορη καφέ αλεπού πηδά πάνω από τα τεμπέλικα σκυλιά"}


def grams(text):
    """Numbers of n-grams by length, and of different ones, word by word."""
    out = Counter()
    letter, part = language._letters()
    for w in "".join(c if part[ord(c)] else " " for c in (text or "").lower()).split(" "):
        if w:
            out.update(w)
            out.update(f" {w} "[i : i + 2] for i in range(len(w) + 1))
            out.update(f" {w} "[i : i + 3] for i in range(len(w)))
    return out


def test_counts_are_those_of_plain_counting_in_any_slices(monkeypatch):
    texts = [None, "", "...", "Ab c", "é" * 50, "x y z 12 aß", "naïve!", "a" * 1000, "1 2 3"]
    whole, has = language.counts(texts)
    monkeypatch.setattr(language, "SLICE", 7)
    cut, _ = language.counts(texts)
    assert (whole == cut).all()
    for row, text in zip(whole, texts):
        want = grams(text)
        assert row.sum() == sum(want.values())
        assert sorted(row[row > 0]) == sorted(want.values()) or len(want) > (row > 0).sum()  # places may be shared
    assert has.tolist() == [False, False, False, True, True, True, True, True, False]


def corpus(spark, repeat=12):
    rows = []
    for lang, text in WORDS.items():
        words = text.split()
        for i in range(repeat):
            rows.append((len(rows), " ".join(words[(i * j + i) % len(words)] for j in range(1, 9)), lang, "clash", 0.0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, cosine string, score double")


def test_nulls_letters_and_strangers(spark):
    docs = corpus(spark)
    model = language.train(docs, max_docs=10)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the lazy dogs wait"), (4, "the lazy dogs wait"), (5, "η αλεπού"), (6, "你好世界 你好"), (None, "andere hunde warten")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["rejected"]) for r in language.predict(odd, model).collect()))
    assert got == [(0, "de", False), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", False), (4, "en", False), (5, "el", False), (6, "und", True)]
    kept = {r["doc_id"]: r for r in language.predict(odd, model, reject=False).collect()}
    assert kept[6]["lang_pred"] in WORDS and kept[6]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in kept.values()) and kept[1]["score"] == 0


def test_nothing_to_learn_from(spark):
    docs = corpus(spark)
    for none in (docs.limit(0), docs.withColumn("lang", docs["lang"].substr(99, 1)).where("lang is null"), docs.selectExpr("doc_id", "'...' as text", "lang")):
        model = language.train(none)
        assert {(r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), language.train(docs)).count() == 0


def test_centroids_part_what_a_language_mixes():
    a, b = np.eye(4)[[0, 0, 1, 1]], np.eye(4)[[0]]
    centre, of = language.cluster(a, 2)
    assert len(centre) == 2 and of[0] == of[1] != of[2] == of[3]
    assert len(language.cluster(b, 4)[0]) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    got = language.op12_nearest_centroid_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() >= 0.98
    assert got.rejected.mean() < 0.05
