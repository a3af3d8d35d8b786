import pytest
from pyspark.sql import Window, functions as F

from factlens.operators import embed, evidence as E, search as S, text as T, units as U, windows as WN

CORPUS = [
    (0, 1, "Coal production report coal production output tonnes output"),
    (1, 1, "Coal production increased tonnes output"),
    (2, 2, "Mine planning safety coal production"),
    (3, 2, "Mine planning safety review"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return T.corpus(spark.createDataFrame(CORPUS, "unit_id long, document_id long, content string"))


def test_tokens(spark):
    row = spark.createDataFrame([("Coal Production  Report, 2024-25!", "The production of coal 2024 is up")], "a string, b string").select(T.tokens(F.col("a")), T.content_tokens(F.col("b"))).first()
    assert row[0] == ["coal", "production", "report", "2024-25"] and row[1] == ["production", "coal"]


def test_terms_and_phrases(corpus):
    got = {r.term: (r.freq, r.df, round(r.score, 4)) for r in T.term_stats(corpus).collect()}
    assert got == {"coal": (4, 2, 4.0), "production": (4, 2, 4.0), "output": (3, 1, 4.2164), "mine": (2, 1, 2.8109), "planning": (2, 1, 2.8109), "safety": (2, 1, 2.8109), "tonnes": (2, 1, 2.8109)}
    assert {r.term: r.freq for r in T.phrases(corpus).collect()} == {"coal production": 4, "mine planning": 2, "mine planning safety": 2, "planning safety": 2, "tonnes output": 2}
    assert {r.display for r in T.display_forms(corpus, T.term_stats(corpus)).collect()} >= {"Coal", "Production", "Mine"}
    assert T.cloud(T.term_stats(corpus)).first().weight == 1.0


def test_phrases_a_priori(spark):
    """What may be frequent holds every occurrence of what is; ties at the bound, gaps by short words, few phrases and no rows."""
    texts = [(i, i % 7, " ".join(f"w{'xyz'[(i * k) % 3]}{(i * k * k) % (11 + k % 5)}x" if k % 9 else "ab" for k in range(40)) + "".join(f" once{i}q{k}" for k in range(40))) for i in range(60)] + [(60, 8, None), (61, 8, ""), (62, 8, "one two")]
    units = T.corpus(spark.createDataFrame(texts, "unit_id long, document_id long, content string"))
    split = units.withColumn("__tokens", T.content_tokens(F.col("content")))
    for top, probe in ((30, 30), (5, 1000), (100_000, 1000), (None, 1000)):
        plain = T.term_stats(split, T.ngrams(F.col("__tokens"), min_chars=3), top=top)
        kept = T.term_stats(T.phrase_candidates(units, top, probe=probe), F.col("__phrases"), top=top)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, plain.collect())), (top, probe)
    occurrences = T.phrase_candidates(units, 5).select(F.sum(F.size(F.filter("__phrases", lambda p: p.isNotNull())))).first()[0]
    assert occurrences * 2 < split.select(F.sum(F.size(T.ngrams(F.col("__tokens"), min_chars=3)))).first()[0]
    assert T.phrases(units.limit(0)).count() == 0


def test_topics(corpus):
    found = T.topics(corpus)
    rows = found.orderBy("topic").collect()
    assert [(r.label, round(r.score, 4)) for r in rows] == [("Output / Coal", 15.0273), ("Mine / Planning", 8.4328)]
    docs = {}
    for r in T.topic_documents(found, corpus).collect():
        docs.setdefault(r.topic, set()).add(r.document_id)
    assert docs == {1: {1, 2}, 2: {2}}


def test_budget(spark):
    units = spark.createDataFrame(CORPUS, "unit_id long, document_id long, content string")
    assert [r.unit_id for r in T.corpus(units, total_chars=110).orderBy("unit_id").collect()] == [0, 1]
    assert T.corpus(units, per_document=1).count() == 2


def test_budget_of_hot_document(spark):
    """A document with most rows is several windows, whose sums go on from one another; null documents and ties too."""
    rows = [(None if i % 10 == 1 else 7 if i % 3 else i % 40, i // 2, i % 5) for i in range(6000)]
    df = spark.createDataFrame(rows, "document_id long, unit_id long, n long")
    amount = F.col("n") + 1
    dealt = df.withColumn("part", WN.part_of(["document_id", "unit_id"], WN.split_points(df, ["document_id", "unit_id"], 40)))
    assert dealt.groupBy("document_id", "part").count().agg(F.max("count")).first()[0] < 600  # document 7 has over 3,000
    ends = dealt.groupBy("part").agg(F.min(F.struct("document_id", "unit_id")).alias("a"), F.max(F.struct("document_id", "unit_id")).alias("b")).orderBy("part").collect()
    low = lambda s: tuple(-1 if x is None else x for x in s)
    assert all(low(x.b) < low(y.a) for x, y in zip(ends, ends[1:]))
    plain = df.withColumn("used", F.sum(amount).over(Window.partitionBy("document_id").orderBy("unit_id", "n").rowsBetween(Window.unboundedPreceding, 0))).where("used <= 5000")
    got = WN.running_budget(df, ["document_id"], ["unit_id", "n"], amount, 5000, 40)
    assert got.columns == plain.columns and sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
    everything = df.withColumn("used", F.sum(amount).over(Window.partitionBy(F.lit(1)).orderBy("document_id", "unit_id", "n").rowsBetween(Window.unboundedPreceding, 0))).where("used <= 9000")
    assert sorted(WN.global_budget(df, "document_id", ["unit_id", "n"], amount, 9000, 40).collect(), key=str) == sorted(everything.collect(), key=str)
    assert WN.running_budget(df.limit(0), ["document_id"], ["unit_id"], amount, 9).count() == 0


def unit(spark, *rows):
    return spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], "unit_id long, document_id long, unit_type string, title string, content string, entity string, metric string")


def test_lexical_scores(spark):
    u = unit(spark, ("page", "A", "about coal production here", None, None), ("record", "B", "demo", "DEMO_MINE_A", "demo_coal"))
    assert {r.unit_id: r.score for r in S.lexical(u, ["coal production"], []).collect()} == {0: 42.0}
    assert {r.unit_id: r.score for r in S.lexical(u, [], ["coal"]).collect()} == {0: 23.0}
    assert S.lexical(u, [], []).count() == 0
    assert S.lexical(u, [], ["100%"]).count() == 0  # literal, no pattern
    q = S.prepare(spark.createDataFrame([(1, '"coal production" about'), (2, ""), (3, "x" * 5000)], "query_id long, text string"), max_chars=300, max_terms=20)
    assert [(r.phrases, len("".join(r.keywords))) for r in q.orderBy("query_id").collect()] == [(["coal production"], 5), ([], 0), ([], 300)]
    assert [(r.query_id, r.unit_id, r["rank"]) for r in S.batch_lexical(u, q, 5).collect()] == [(1, 0, 1)]


def test_cosine_and_modes(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(S.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, -1.0, 0.0, 0.0]
    u = unit(spark, ("page", "A", "coal", None, None), ("record", "B", "iron", None, None)).withColumn("embedding_status", F.lit("embedded")).withColumn("embedding", F.when(F.col("unit_id") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    q = spark.createDataFrame([(1, "coal", "hybrid", [0.0, 1.0]), (2, "iron", "hybrid", None), (3, "coal", "semantic", [0.0, 1.0])], "query_id long, text string, mode string, query_vector array<float>")
    out = {(r.query_id, r.unit_id): (r.mode, round(r.relevance, 4)) for r in S.run(u, q).collect()}
    assert out[(1, 0)] == ("hybrid", 0.8) and out[(1, 1)] == ("hybrid", 0.4)
    assert out[(2, 1)][0] == "lexical" and out[(3, 1)] == ("semantic", 1.0)


def test_evidence_and_contract(spark):
    hits = spark.createDataFrame([(1, i, f"t{i}", "c " * 300, i) for i in (1, 2, 3)], "query_id long, unit_id long, title string, content string, rank int")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    e = E.build(asked, hits, max_chars=900)
    assert {(r.query_id, r.evidence_id, r.status) for r in e.collect()} == {(1, 1, "ok"), (1, 2, "ok"), (2, None, "insufficient_evidence")}
    said = [(1, '{"answer":"x","citations":["1","9"],"confidence":"low"}'), (2, '{"answer":"x"}'), (3, "oops")]
    out = {r.query_id: (r.error, r.citations, r.dropped) for r in E.check_answers(spark.createDataFrame(said, "query_id long, response string"), e).collect()}
    assert out == {1: (None, ["1"], ["9"]), 2: ("keys", [], []), 3: ("not_json", [], [])}


def test_units_and_embedding(spark):
    u = unit(spark, ("page", "A", "x\ny", None, None), ("record", "B", None, None, None), ("page", "", "", None, None)).withColumns({"unit": F.lit("t"), "reporting_period": F.lit(None).cast("string"), "source_reference": F.lit("p")})

    def load():
        return lambda texts: [[float(len(t))] for t in texts]

    got = {r.unit_id: (r.embedding, r.embedding_status) for r in embed.run(u, load).collect()}
    assert got == {0: ([7.0], "embedded"), 1: ([9.0], "embedded")}
    assert {r.embedding_status for r in embed.run(u, None).collect()} == {"unavailable"}

    def broken():
        def fail(texts):
            raise ValueError("down")

        return fail

    assert {(r.embedding_status, r.embedding_error) for r in embed.run(u, broken).collect()} == {("failed", "ValueError: down")}
    assert {r.embedding_status for r in embed.attach(u, embed.run(u, load)).collect()} == {"embedded", "none"}
    assert U.embedding_inputs(u, 3).where("unit_id = 0").first().input_text == "A |"


def test_answers_of_the_wrong_type(spark):
    rows = [(1, '{"answer": "x", "citations": ["1"], "confidence": "high"}', None), (2, '{"answer": "x", "citations": ["1"], "confidence": ["high"]}', "types"), (3, '{"answer": "x", "citations": ["1"], "confidence": 0.9}', "types"),
            (4, '{"answer": 5, "citations": ["1"], "confidence": "high"}', "types"), (5, '{"answer": "x", "citations": "1", "confidence": "high"}', "types"), (6, '{"answer": "x", "citations": [1], "confidence": "low"}', None), (7, "[1]", "not_json"),
            (8, '{"answer": "x", "citations": [], "confidence": "low"}', None), (9, None, "not_json")]
    evidence = spark.createDataFrame([(i, 1) for i in range(1, 10)], "query_id int, evidence_id int")
    out = E.check_answers(spark.createDataFrame([r[:2] for r in rows], "query_id int, response string"), evidence).collect()
    assert {r.query_id: r.error for r in out} == {r[0]: r[2] for r in rows}


def test_batch_search_equals_each_query_alone(spark):
    import random

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    units = spark.createDataFrame([(i, 1, "page", text(3), text(rng.randrange(0, 40)), None, None) for i in range(60)] + [(99, 1, "record", None, None, None, None)], "unit_id long, document_id long, unit_type string, title string, content string, entity string, metric string")
    asked = [(i, " ".join(text(rng.randrange(1, 5)) for _ in range(2)) if i % 4 else f'"{text(4)}"') for i in range(80)] + [(90, ""), (91, None), (92, "a")]
    prepared = S.prepare(spark.createDataFrame(asked, "query_id long, text string"))
    got = sorted((r.query_id, r.unit_id, r.score) for r in S.batch_lexical(units, prepared).collect())
    rows = {r.unit_id: (f"{r.title or ''} {r.content or ''}".lower(), r.unit_type) for r in units.collect()}
    want = []
    for q in prepared.collect():
        terms = [*q.phrases, *q.keywords]
        for u, (t, kind) in rows.items():
            if terms and all(x.lower() in t for x in terms):
                score = 40 * len(q.phrases) + (15 if q.keywords else 0) + 6 * min(3, len(q.keywords)) + {"record": 3, "page": 2}[kind]
                want.append((q.query_id, u, float(score)))
    assert got == sorted(want) and len(got) > 30
    assert {r.query_id: r.total for r in S.totals(S.batch_lexical(units, prepared)).collect()} == {q: sum(x[0] == q for x in want) for q in {x[0] for x in want}}


def test_top_lists_only(spark, corpus):
    many = spark.range(2000).selectExpr("cast(id as string) as term")
    with pytest.raises(ValueError):
        T.cooccurrence(corpus, many)


def test_counts_sum_up_no_table_of_a_split(spark):
    rows = [(1, 1, "b a b"), (2, 1, "b c"), (3, 2, "a a"), (4, None, "a"), (5, None, "c"), (6, 3, ""), (7, 3, None)]
    units = spark.createDataFrame(rows, "unit_id int, document_id int, content string").withColumn("words", F.filter(F.split("content", " "), lambda w: w != ""))
    got = T.counts(units, F.col("words"))
    assert sorted(map(tuple, got.collect())) == [("a", 4, 3), ("b", 3, 1), ("c", 2, 2)]
    by = T.counts(units, F.col("words"), by=("document_id",)).where("document_id = 1")
    assert sorted(map(tuple, by.collect())) == [(1, "a", 1, 1), (1, "b", 3, 1), (1, "c", 1, 1)]
    # What is read and split goes to the exchange as it comes: an aggregate before it would hold all terms of all documents of its split.
    plan = got._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.rindex("Exchange hashpartitioning(term") :]
    assert "Generate" in before and "HashAggregate" not in before
