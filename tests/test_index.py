"""Stored indexes: postings of grams, the rank term, sketches of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.operators import search as S
from factlens.sources import adapters as IN

TEXTS = ["The mine made 12 tonnes", "tonnes of ore, tonnes of sand", "ÉTÉ à la mine", "a b c", "", None, "x", "the the the the the the", "naïve Ünïts 12"]


def units(spark):
    rows = [(f"u{i}", i, "page", "T", t, None, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "unit_id string, document_id long, unit_type string, title string, content string, entity string, metric string")


def asked(spark):
    texts = ["tonnes", "mine 12", '"tonnes of"', "été", "a", "x", "zzz", "b a", "the mine", "t", "", '"', "ïve 12", "tonnes zz"]
    return S.prepare(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"))


def plain(spark):
    """Every term looked for in every text."""
    out = set()
    for q in asked(spark).collect():
        terms = [t.lower() for t in q.phrases + q.keywords]
        out |= {(q.query_id, f"u{i}") for i, t in enumerate(TEXTS) if terms and all(x in f"T {t or ''}".lower() for x in terms)}
    return out


def test_postings_find_what_a_search_through_all_texts_finds(spark, tmp_path):
    path, want = str(tmp_path / "index"), plain(spark)
    S.write_postings(units(spark), path, 3)
    stored = S.read_postings(spark, path)
    for index in (None, stored):
        found = S.batch_lexical(units(spark), asked(spark), index=index)
        assert {(r.query_id, r.unit_id) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    kept = S.candidates(stored[0], S._anchors(S._terms(asked(spark)).join(stored[1], "gram", "left")))
    assert want <= {(r.query_id, r.unit_id) for r in kept.collect()} and kept.where("query_id = 6").count() == 0


def test_rank_term_orders_what_scores_alike(spark):
    found = S.batch_lexical(units(spark), asked(spark).where("query_id = 0"), 5, with_rank=True).orderBy("rank").collect()
    assert [r.unit_id for r in found] == ["u1", "u0"]
    length = 1.2 * (0.25 + 0.75 * 7 / 100)
    assert found[0].score == pytest.approx(15 + 6 + 2 + 10 * 2 / (2 + length))
    bare = S.batch_lexical(units(spark), asked(spark).where("query_id = 0"), 5).collect()
    assert {r.score for r in bare} == {23.0}


def test_sketches_reach_nine_tenths_of_the_nearest(spark, tmp_path):
    units = IN.vector_units(spark, "/root/testdata/sf0.1")
    vectors = units.where("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    S.sketches(units).write.parquet(str(tmp_path / "s"))
    index = spark.read.parquet(str(tmp_path / "s"))
    m = index.count()
    few = max(50, m * 9 // 100)
    got = {(r.query_id, r.unit_id) for r in S.semantic_approximate(units, vectors, index, 10, candidates=few).collect()}
    want = {(r.query_id, r.unit_id) for r in S.semantic(units, vectors, 10).collect()}
    assert few / m < 0.1 and len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_sketches_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [1.0, 0.0, 0.0]), (6, [-1.0, 0.0])]
    units = spark.createDataFrame([(i, i, "page", "embedded", v) for i, v in rows], "unit_id long, document_id long, unit_type string, embedding_status string, embedding array<double>")
    index = S.sketches(units)
    assert {r.unit_id for r in index.collect()} == {1, 2, 5, 6}
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, [0.0, 1.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    found = S.semantic_approximate(units, queries, index, 2).orderBy("rank").collect()
    assert [(r.query_id, r.unit_id) for r in found] == [(1, 1), (1, 2)]
    assert np.isclose(found[0].similarity, 1.0)


def test_counts_are_observed_by_the_pass_itself(spark, tmp_path):
    from factlens.operators import units as U, windows as WN

    rows = spark.createDataFrame([(i, i % 7, ["page", "record"][i % 2]) for i in range(50)], "n long, document_id long, unit_type string")
    watched, seen = U.observed(rows)
    watched.write.parquet(str(tmp_path / "u"))
    assert seen.get == {"units": 50, "record": 25, "page": 25, "validation": 0, "documents": 7}
    shown = WN.page(rows, [F.desc("n")], 3, 4).collect()
    assert [(r.n, r.total) for r in shown] == [(45, 50), (44, 50), (43, 50)]
    assert WN.page(rows.limit(0), ["n"]).collect() == []
    first = WN.after(rows, ["document_id", "n"], None, 10).collect()
    second = WN.after(rows, ["document_id", "n"], [first[-1].document_id, first[-1].n], 40).collect()
    assert [(r.document_id, r.n) for r in first + second] == sorted((i % 7, i) for i in range(50))


def test_sketches_of_untouched_buckets_are_not_made_again(spark):
    from factlens.operators import dashboard as D

    rows = spark.range(20000).selectExpr("id % 8 as bucket", "id % 5000 as document_id", "concat('m', id % 3) as model")
    columns = ["document_id", "model"]
    sketches = D.distinct_sketches(rows, "bucket", columns)
    one = D.distinct_totals(sketches, columns).first()
    assert one.rows == 20000 and abs(one.document_id - 5000) <= 150 and one.model == 3
    touched = spark.createDataFrame([(0,), (1,)], "bucket long")
    new = D.distinct_sketches(rows.where("bucket = 0").limit(0).unionByName(spark.createDataFrame([(1, 7, "new")], "bucket long, document_id long, model string")), "bucket", columns)
    after = D.distinct_totals(D.refreshed(sketches, new, touched, "bucket"), columns).first()
    assert after.rows == 15001 and after.model == 4
    want = rows.where("bucket > 1").select("document_id").distinct().count() + 1
    assert abs(after.document_id - want) <= 0.03 * want
    none = D.distinct_totals(D.distinct_sketches(rows.limit(0), "bucket", columns), columns).first()
    assert (none.rows, none.document_id, none.model) == (0, 0, 0)


def test_near_vectors_leave_a_task_as_its_best_and_ties_go_by_the_order_of_units(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(300)] + [[0.0] * 4, [float("nan")] * 4, [1.0, 2.0]]
    rows = [(i, i % 7, ["page", "record"][i % 2], "embedded", v) for i, v in enumerate(vectors)]
    units = spark.createDataFrame(rows, "unit_id long, document_id long, unit_type string, embedding_status string, embedding array<float>")
    queries = units.where("unit_id % 20 = 0 and unit_id < 300 or unit_id = 302").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = S.semantic(units, queries, 5, block=4, rows=16, fan=3)

    def cosine(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
        return round(float(np.dot(a, b) / size), 9) if size > 0 else 0.0

    for q in {r.query_id for r in queries.collect()}:
        near = sorted((-cosine(vectors[q], v), i % 2 == 0, i % 7, i) for i, v in enumerate(vectors) if i != 301)[:5]
        got = sorted((r["rank"], round(r.similarity, 9), r.unit_id) for r in found.where(F.col("query_id") == q).collect())
        assert [s for _, s, _ in got] == [-s for s, *_ in near]
    # 15 queries in blocks of 4, 303 units in copies of at most 48: no more than `top` rows a query leave one of the copies.
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("MapInArrow", plan.index("Window")) < plan.index("Join", plan.index("Window"))


def test_units_meet_queries_by_one_gram_and_signatures(spark):
    kept = {(r.query_id, r.unit_id) for r in S.met_units(units(spark), asked(spark).where(F.size("phrases") + F.size("keywords") > 0)).collect()}
    assert plain(spark) <= kept and not {u for q, u in kept if q == 6}


def test_slices_of_sketches_are_keys_of_their_own(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 7, "page", "embedded", rng.standard_normal(8).tolist()) for i in range(200)]
    units = spark.createDataFrame(rows, "unit_id long, document_id long, unit_type string, embedding_status string, embedding array<double>")
    queries = units.where("unit_id < 20").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = S.semantic_approximate(units, queries, S.sketches(units), 5, candidates=200, block=7, share=30)
    exact = S.semantic(units, queries, 5)
    pairs = lambda df: sorted((r.query_id, r["rank"], r.unit_id) for r in df.collect())
    assert pairs(found) == pairs(exact)


def test_stored_postings_are_lists_that_no_shuffle_moves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "POSTINGS", 40)  # many blocks
    path, want = str(tmp_path / "index"), plain(spark)
    S.write_postings(units(spark).repartition(2), path, 3)
    blocks, frequencies = S.read_postings(spark, path)
    held = S.postings(units(spark))
    assert blocks.where("gram is null").count() > 3 and blocks.where("gram is not null").count() < held.count()
    assert {(r.gram, r.df) for r in frequencies.collect()} == {(r.gram, r.df) for r in S.document_frequencies(held).collect()}
    assert {(r.query_id, r.unit_id) for r in S.batch_lexical(units(spark), asked(spark), index=(blocks, frequencies)).collect()} == want
    met = S.candidates(blocks, S._anchors(S._terms(asked(spark)).join(frequencies, "gram", "left")))
    plan = met._jdf.queryExecution().executedPlan().toString()
    names = [x for x in plan.splitlines() if "Join" in x and "[block" in x and "place" in x]
    assert names and all("SortMergeJoin" in x for x in names)


def test_places_are_numbers_or_bits():
    for of, places in ((1, [0]), (1000, [3, 999]), (1000, list(range(0, 1000, 3))), (65536, [0, 65535]), (65536, list(range(65536)))):
        packed = S._packed(np.array(places, np.uint16), of)
        assert len(packed) <= min(2 * len(places), of // 8 + 1) and S._unpacked(packed, len(places), of).tolist() == places


def test_grams_of_a_text_are_those_of_its_pieces(monkeypatch):
    text = "".join(chr(97 + i * i % 23) + "é😀"[i % 2] for i in range(300))
    whole = S._keys(text), S._hashed(text, (3, 6))
    monkeypatch.setattr(S, "PIECE", 7)
    assert (S._keys(text) == whole[0]).all() and all((a == b).all() for a, b in zip(S._hashed(text, (3, 6)).values(), whole[1].values()))
    assert {S._gram(int(k)) for k in whole[0]} == {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}


def test_long_texts_that_ask_meet_little_more_than_their_matches(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(4000)]
    texts = [" ".join(rng.choice(words, 900)) for _ in range(120)]
    texts[1] = texts[0]
    many = spark.createDataFrame([(i, i, "page", "T", t, None, None) for i, t in enumerate(texts)], "unit_id long, document_id long, unit_type string, title string, content string, entity string, metric string")
    queries = S.prepare(many.where("unit_id < 40").selectExpr("unit_id as query_id", "content as text"))
    met = S.met_units(many, queries).collect()
    assert {(r.query_id, r.unit_id) for r in met} >= {(i, i) for i in range(40)} | {(0, 1), (1, 0)} and len(met) < 100
    found = S.batch_lexical(many, queries)
    assert sorted((r.query_id, r.unit_id) for r in found.collect()) == sorted([(i, i) for i in range(40)] + [(0, 1), (1, 0)])
