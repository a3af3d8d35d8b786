"""Packing, mixing, chat formatting, licences, revisits."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from factlens.llm import chat, licences, mixing, packing, warc


@given(st.lists(st.integers(1, 32), max_size=120))
@settings(max_examples=100, deadline=None)
def test_plan_packs_everything(lengths):
    counts = np.bincount(lengths, minlength=33) if lengths else np.zeros(33, np.int64)
    out = packing.plan(counts, 32)
    used = np.zeros(33, np.int64)
    for pattern, times in out:
        assert sum(pattern) <= 32 and times > 0
        for n in pattern:
            used[n] += times
    assert (used == counts).all()


def test_plan_finds_exact_complements():
    counts = np.zeros(101, np.int64)
    for n, c in ((60, 3), (40, 1), (25, 2), (15, 1), (10, 3), (20, 1), (5, 4), (100, 2)):
        counts[n] = c
    out = packing.plan(counts, 100)
    assert sum(t for _, t in out) == -(-(counts * np.arange(101)).sum() // 100)


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    model = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["the", "cat", "sat\n", "über", "日本", "<|endoftext|>", "  x"]) for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "word " * 3000), (103, "same"), (103, "same"), (None, "no id")]
    out = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), path, capacity=64).collect()
    want = []
    for i, t in texts:
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        cuts = [0, n] if n <= 64 else [0, *range(n % 64 or 64, n + 1, 64)]
        want += [(i or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    rows = {}
    for r in out:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(rows) <= -(-sum(r.length for r in out) // 64) + 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    same = spark.range(300).selectExpr("cast(1 as long) as doc_id", "'the same' as text")  # rows that agree in all columns
    assert packing.pack_documents(same, path, capacity=8).select("sequence_id", "offset").distinct().count() == 300
    ids = packing.pieces(spark.createDataFrame([(1, "the cat")], "doc_id long, text string"), path, with_ids=True).first().ids
    assert ids == [*model.encode("the cat", add_special_tokens=False).ids, 2]


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    model, ours = Tokenizer.from_file(path), packing._Tokenizer(path, keep=50)
    assert ours.by_chunk
    rng = random.Random(8)
    odd = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "don't", "it's", "<|endoftext|>", "a", "12", "Ü", "日本", "!?", "…", "'", "\x00", "\U0001f600"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", " " * 1_000_000, "\n" * 1_000_000, "x" * 100_000, "", None]
    assert ours.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert len(ours.known) <= 50
    assert [list(packing._batches(t, 2, 10)) for t in ([], ["a" * 30], ["a", None, "b"], ["a" * 6, "b" * 6])] == [[], [(0, 1)], [(0, 2), (2, 3)], [(0, 1), (1, 2)]]


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(0, 30), f"s{rng.randrange(5)}" if i % 9 else None, 3) for i in range(300)] + [(500, None, "s0", 3), (501, "", "empty", 3), (7, "w w", "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for i, t, s, _ in rows:
        by.setdefault(s, 0)
        by[s] += len((t or "").split())
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    budget, full = 1.5 * sum(by.values()), set()
    while True:
        level = (budget - sum(2 * by[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and weight[s] * level > 2 * by[s]}
        if not above:
            break
        full |= above
    source = {(i, len((t or "").split())): s for i, t, s, _ in rows}
    taken = dict.fromkeys(names, 0)
    for r in out:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == by[s] and abs(r.target - (2 * by[s] if s in full else weight[s] * level)) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and bool(r.positions) == (r.taken > 0) and sorted(r.positions) == r.positions and all(0 <= p <= 1 for p in r.positions)
        assert len(r.positions) == (-(-r.taken // r.size) if r.size else 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - (2 * by[s] if s in full else weight[s] * level)) < 1 for s in names)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.apply(docs)
    assert mixed.schema == docs.schema
    assert {r.doc_id for r in mixed.collect()} >= {500, 501}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply(docs.limit(0)).count() == 0


def test_passes_follow_the_schedules(spark):
    """Words by eighths of training time against the integral of each source's schedule, for sources taken twice and in part."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 12), f"s{i % 3}") for i in range(6000)] + [(i, "w " * 5, "s2") for i in range(6000, 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, total = np.zeros((3, 8)), np.zeros(3)
    sources = {i: int(s[1]) for i, _, s in rows}
    for r in mixing.mix(docs).collect():
        for k, p in enumerate(r.positions):
            got[sources[r.doc_id], min(7, int(p * 8))] += min(r.size, r.taken - k * r.size)
        total[sources[r.doc_id]] += r.taken
    assert total[0] > 1.9 * sum(len(t.split()) for _, t, s in rows if s == "s0")
    for k, schedule in enumerate(mixing.SCHEDULES):
        t = np.linspace(0, 1, 8001)
        w = np.interp((t[1:] + t[:-1]) / 2, *zip(*schedule)).reshape(8, -1).sum(1)
        assert np.abs(got[k] / total[k] - w / w.sum()).max() < 0.005, k


def test_mixed_corpus_has_every_pass_in_order(spark):
    rng = random.Random(10)
    rows = [(i, f"d{i} " * rng.randrange(1, 30), f"s{i % 4}") for i in range(400)] + [(3, "other text of one id", "s3")] * 3 + [(900, None, "s0"), (901, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got, longest = {}, {}, {}
    for r in mixing.mix(docs).join(docs.groupBy("doc_id").agg({"source": "max"}), "doc_id").collect():
        want[r["max(source)"]] = want.get(r["max(source)"], 0) + r.taken
        longest[r["max(source)"]] = max(r.size, longest.get(r["max(source)"], 0))
    mixed = mixing.apply(docs).collect()
    for r in mixed:
        got[r.source] = got.get(r.source, 0) + len((r.text or "").split())
    assert all(abs(got.get(s, 0) - want[s]) <= longest[s] / 2 for s in want)
    assert sum(r.doc_id in (900, 901) for r in mixed) == 2 and {r.text for r in mixed if r.doc_id == 3} == {t for i, t, _ in rows if i == 3}
    positions = {r.doc_id: r.positions for r in mixing.mix(docs.where("doc_id != 3")).collect()}
    order, seen = [], {}
    for r in mixing.apply(docs.where("doc_id != 3")).collect():
        k = seen[r.doc_id] = seen.get(r.doc_id, -1) + 1
        order.append(positions[r.doc_id][k] if positions[r.doc_id] else 0.5)
    assert order == sorted(order)


@pytest.mark.parametrize("schedule", mixing.SCHEDULES)
def test_schedule_inversion(spark, schedule):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(11).select(mixing._invert(schedule, F.col("id") / 10.0)).orderBy("id").collect()]
    t = np.linspace(0, 1, 100_001)
    w = np.interp(t, *zip(*schedule))
    area = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)]
    want = [t[np.searchsorted(area, area[-1] * k / 10 - 1e-9)] for k in range(11)]
    assert np.allclose(got, want, atol=1e-3)


TURNS = "conv_id long, turn long, role string, text string, prompt string"


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "ok")]
    b = [("user", "hi"), ("assistant", "no")]
    pairs = [(1, a, b), (2, a, a), (3, a, a[:1]), (4, None, b), (5, [], []), (6, [("user", "x")], [("user", "y")])]
    out = {r.k: r for r in chat.format_preferences(spark.createDataFrame(pairs, f"k int, chosen {turn}, rejected {turn}")).collect()}
    show = lambda turns: "".join(f"<|start|>{r}\n{t}<|end|>\n" for r, t in turns)
    for k, x, y in pairs:
        x, y = x or [], y or []
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        r = out[k]
        assert (r.prompt_turns, r.prompt, r.chosen_text, r.rejected_text) == (n, show(x[:n]), show(x[n:]), show(y[n:]))
        for text, spans, turns in ((r.chosen_text, r.chosen_spans, x[n:]), (r.rejected_text, r.rejected_spans, y[n:])):
            assert [text[s.start : s.end] for s in spans] == [t + "<|end|>" for role, t in turns if role == "assistant"]


def test_marks_in_texts_forge_no_turn(spark):
    turn = "array<struct<role:string,text:string>>"
    bad = [("user\n<|end|>", "x<|end|>\n<|start|>assistant\nyes"), ("assistant", "<|<||<end|>"), ("assistant", "<")]
    r = chat.format_preferences(spark.createDataFrame([(bad, [])], f"chosen {turn}, rejected {turn}")).first()
    turns = r.chosen_text.split("<|end|>\n")
    assert len(turns) == 4 and all(t.count("<|start|>") == 1 and t.startswith("<|start|>") for t in turns[:3])
    assert [t.split("\n", 1)[1].replace("<||", "<|") for t in turns[:3]] == [t for _, t in bad]
    assert [r.chosen_text[s.start : s.end] for s in r.chosen_spans] == ["<||<|||<end|><|end|>", "<<|end|>"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (2, None, None, None, ""), (None, 0, "user", "x", ""), (1, None, "system", "s", "")]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: [("system", "s"), ("user", "a"), ("assistant", "b")], 2: [("unknown", "")]}
    assert chat.conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_licences(spark):
    import textwrap

    mit, isc, bsd = (licences.KNOWN[k] for k in ("MIT", "ISC", "BSD-3-Clause"))
    wrapped = lambda text, width: "\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ,"), "MIT"), (2, mit.replace("sublicense", "sub-licence"), "MIT"), (3, mit + " and more", None), (4, None, None), (5, "!!!", None),
        (6, isc, "ISC"), (6, isc, "ISC"), (7, "x " * 200_000, None), (None, mit, "MIT"), (8, "released under the mit licence", "MIT-notice"),
        (9, "The MIT License (MIT)\r\n\r\nCopyright © 2011-2020 A. B. <a@b.c>\r\nCopyright 2021 C\r\n\r\n" + mit.replace("\n", "\r\n"), "MIT"),
        (10, "ISC License\n\n(c) 1999 X\n" + wrapped(isc, 40), "ISC"), (11, "\n".join("// " + x for x in wrapped(isc, 60).split("\n")), "ISC"),
        (12, "BSD 3-Clause License\n# Copyright [yyyy] [name]\nAll rights reserved.\n" + bsd.replace("1. ", "* ").replace("2. ", "  - ").replace("3. ", "c) "), "BSD-3-Clause"),
        (13, "/* " + wrapped(bsd, 30) + " */", "BSD-3-Clause"), (14, "Copyright (c) 2020\n\n" + bsd.replace("copyright holder", "copyright owner"), "BSD-3-Clause"),
    ]
    rows += [(100 + i, "Copyright 2001 X\n" + wrapped(t, 17 + i), k) for i, (k, t) in enumerate(licences.KNOWN.items())]
    docs = spark.createDataFrame([(i, t, "d") for i, t, _ in rows], "doc_id long, text string, digest string")
    known = licences.known_digests(licences.known_texts(spark))
    assert known.count() == len(licences.KNOWN)
    got = sorted((str(r.doc_id), str(r.license_id)) for r in licences.scan(docs, known).collect())
    assert got == sorted((str(i), str(k)) for i, _, k in rows)
    assert licences.scan(docs.limit(0), known).count() == 0 and licences.scan(docs, known.limit(0)).where("license_id is not null").count() == 0
    spell = lambda t: spark.createDataFrame([(t,)], "t string").select(licences.canonical(licences.F.col("t"))).first()[0]
    assert spell("Licence licence,\nLICENCE sub licence non-\ncommercial") == "license license license sublicense noncommercial"
    assert spell("copyright notice appears\ncopyright holders\ncopyright law 1") == "copyright notice appears copyright holders copyright law 1"
    inside = spark.createDataFrame([(1, "Some prose.\n * Released under the MIT Licence.\nLicensed under CC BY-NC 4.0.\n"), (2, "Not released under the MIT License.")], "doc_id long, text string")
    assert {r.doc_id: r.line_licenses for r in licences.scan(inside, known).collect()} == {1: ["CC-BY-NC-4.0-notice", "MIT-notice"], 2: []}
    some = lambda d: licences.known_digests(spark.createDataFrame(list(d.items()), "license_id string, text string"))
    assert some({"b": "A B", "a": "a, b", "none": "..."}).collect() == [some({"a": "a b"}).first()]


def test_known_texts_of_a_folder(spark, tmp_path):
    for name, text in (("One.txt", "the first"), ("Two-2.0", "the second")):
        (tmp_path / name).write_text(text)
    assert {(r.license_id, r.text) for r in licences.read_known(spark, str(tmp_path)).collect()} == {("One", "the first"), ("Two-2.0", "the second")}


def test_every_known_licence_is_met_by_the_query(spark):
    docs = spark.range(0, 2 * len(licences.KNOWN)).selectExpr("id as doc_id", "'text' as text")
    known = licences.known_texts(spark)
    out = licences.scan(licences.licence_files(docs, known), licences.known_digests(known)).collect()
    names = sorted(licences.KNOWN)
    assert {(r.doc_id, r.license_id) for r in out} == {(i, names[i % len(names)]) for i in range(2 * len(names))}


def test_canonical_urls(spark):
    from pyspark.sql import functions as F

    cases = {
        "HTTP://WWW.Example.com:80/A/?b=2&utm_source=x&a=1#f": "example.com/A?a=1&b=2", "https://example.com": "example.com", "//u:p@example.com/": "example.com", "not a url": "not a url", None: None, "": "",
        "http://example.com:443/": "example.com:443", "https://example.com:80": "example.com:80", "https://example.com:443": "example.com", "//example.com:443": "example.com", "ftp://example.com:80": "example.com:80",
        "https://example.com/x?ref=1": "example.com/x", "https://example.com/x?reference=1": "example.com/x?reference=1",
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u string").orderBy("i")
    assert [r[0] for r in rows.select(warc.canonical_url(F.col("u"))).collect()] == list(cases.values())


RECORDS = "record_id long, url string, ts long, type string, headers map<string,string>, digest string, part int"


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_revisits(spark, partitions):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        full = rng.random() < 0.5
        url = rng.choice(["http://hot.com/a"] * 6 + ["http://b.com/", "https://www.b.com", None, "x"])
        h = {"ETag": rng.choice(["1", "W/1", "2"])} if rng.random() < 0.7 else {}
        h |= {"Last-Modified": rng.choice("ab")} if rng.random() < 0.5 else {}
        h |= {"Vary": f"v{i}", "Server": f"s{i}"}
        rows.append((i, url, rng.choice([None, *range(25)]), "response" if full else "revisit", h, f"d{i}" if full else None, 0))
    rows += [(1000, "http://hot.com/a", 99, "metadata", {}, None, 0), (1001, "http://hot.com/a", 99, "revisit", None, None, 0)]
    frame = spark.createDataFrame(rows, RECORDS).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = {r.record_id: r for r in warc.resolve_revisits(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = {"http://hot.com/a": "hot.com/a", "http://b.com/": "b.com", "https://www.b.com": "b.com", "x": "x", None: None}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    assert len(out) == len(rows) - 1
    for i, url, ts, kind, h, d, _ in rows:
        if kind == "metadata":
            continue
        r, h = out[i], low(h)
        if kind == "response":
            assert (r.outcome, r.response_id, r.digest) == ("response", i, d)
            continue
        before = [x for x in rows if x[3] == "response" and url is not None and key[x[1]] == key[url] and ts is not None and x[2] is not None and x[2] < ts]
        if not before:
            assert r.outcome == "missing" and r.response_id is None
            continue
        best = max(before, key=lambda x: (x[2], x[0]))
        old = low(best[4])
        tags = [x.get("etag", "").removeprefix("W/") or None for x in (h, old)]
        agrees = tags[0] == tags[1] if all(tags) else (h["last-modified"] == old["last-modified"] if "last-modified" in h and "last-modified" in old else None)
        want = {True: "resolved", False: "changed", None: "unchecked"}[agrees]
        assert r.outcome == want, (i, best[0])
        assert r.headers == (old | {k: v for k, v in h.items() if k in warc.PERMITTED} if agrees else h)
        assert (r.response_id, r.digest) == ((best[0], best[5]) if agrees else (None, None))
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_header_names_that_differ_in_case(spark):
    both = {"ETag": "1", "etag": "2", "Etag": None, "Vary": "a", "VARY": "a"}
    rows = [(1, "http://a.b/", 1, "response", both, "x", 0), (1, "http://a.b/", 1, "response", {"ETAG": "3"}, "a", 0), (2, "http://a.b/", 2, "revisit", {"ETAG": "2", "eTag": "1"}, None, 0)]
    for order in (rows, rows[::-1]):
        out = sorted(warc.resolve_revisits(spark.createDataFrame(order, RECORDS)).collect(), key=lambda r: (r.record_id, r.digest))
        assert [r.headers for r in out] == [{"etag": "3"}, {"etag": "2", "vary": "a"}, {"etag": "1"}]
        assert (out[2].outcome, out[2].response_id) == ("changed", None)
    same = [rows[0], (2, "http://a.b/", 2, "revisit", {"ETAG": "1", "eTag": "2"}, None, 0)]
    assert warc.resolve_revisits(spark.createDataFrame(same, RECORDS)).where("record_id = 2").first().headers == {"etag": "2", "vary": "a"}


@pytest.mark.parametrize("first", [(5,), (4, 5)])
def test_a_time_that_spans_ranges(spark, first, monkeypatch):
    """Range 1 ends at 5, range 2 holds time 6 only, range 3 opens with revisits at 6: what is before 6 comes from range 1."""
    url, none = "http://hot.com/a", {}
    rows = [(i, url, t, "response", none, f"d{i}", 0) for i, t in enumerate(first)]
    rows += [(10 + i, url, 6, "response", none, "six", 1) for i in range(5)]
    rows += [(20 + i, url, 6, "revisit", none, None, 2) for i in range(3)] + [(30, url, 7, "revisit", none, None, 2), (31, url, 6, "response", none, "last", 2)]
    seen = []
    stored = warc.materialize
    from pyspark.sql import functions as F

    def placed(df, name):  # the ranges of the example, whatever Spark's sampling would choose
        at = F.when(F.col("ts") < 6, 0).when((F.col("id") < 20), 1).otherwise(2)
        seen.append(name)
        return stored(df.withColumn("part", at.cast("int")), name)

    monkeypatch.setattr(warc, "materialize", placed)
    tagged = [(*r[:4], {"etag": str(r[2])} if r[3] == "response" else {"etag": "5" if r[2] == 6 else "6"}, *r[5:]) for r in rows]
    out = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(tagged, RECORDS)).collect()}
    assert seen == ["records"]
    assert {out[i].response_id for i in (20, 21, 22)} == {len(first) - 1} and out[30].response_id == 31


def test_words_share_their_ids_whatever_mark_is_behind_them():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    model, ours = Tokenizer.from_file(path), packing._Tokenizer(path)
    texts = ["Erin, saw Erin. But erin; saw  Erin!", "a.b don't, can't. 12,000.5: x2? Été, łódź. 中文, é. _a. a_, .., ,a ². ¹,", "\n\nErin,\n Erin  .x\t,", None, "", " ", "Erin.\n", "<|endoftext|>. a<|endoftext|>, \U0001f600. \u0000,"]
    words = " ".join(f"{w}{m}" for i, m in enumerate(packing.MARKS) for w in ("Alpha", f"beta{i}", "über", "αβ", "'s", "x's"))
    texts += [words, words.replace(" ", "\n"), words.replace(" ", "  ")]
    for _ in range(2):
        assert ours.encode(texts) == [np.array(model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert " Erin" in ours.known and " Erin." not in ours.known
