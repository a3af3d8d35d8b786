"""SimHash near-duplicates, substring deduplication and connected components against brute force."""

import functools
import hashlib
import os
import random

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from factlens.llm import minhash, simhash, substring
from factlens.llm.common import shared_dir
from factlens.llm.components import components

DOCS = "doc_id long, text string, fp string, anchor int"  # extra columns whose names the operators use themselves


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    digests = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))


@given(st.text(alphabet="aBé \n\t ", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 260)] + [(300, x) for x in range(301, 360)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = brute_components(edges, {n for e in edges for n in e})
    assert got == {n: want[n] for n in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("distance", [1, 3, 4])
def test_links_are_all_near_pairs(spark, distance):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    flipped = []
    for f in base:
        for n in range(0, 6):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            flipped.append(g)
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in base + flipped})
    got = sorted((r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance).collect())
    want = sorted((a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= distance)
    assert got == want


def test_near_duplicates(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(300)) for _ in range(400))
    texts = [(7, long), (3, long.upper()), (9, long + " end"), (1, None), (2, ""), (4, " \t"), (5, "one"), (6, "one two"), (6, "one two"), (None, long), (8, "x" * 100_000)]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = {(i, slow_fingerprint(t)): i for i, t in texts}
    keys = list(prints)
    near = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if bin(a[1] ^ b[1]).count("1") <= 3]
    groups = {}
    for n, r in brute_components([(keys.index(a), keys.index(b)) for a, b in near], range(len(keys))).items():
        groups.setdefault(r, []).append(keys[n])
    want = {k: min((x[0] for x in g if x[0] is not None), default=None) for g in groups.values() for k in g}
    assert {(i, f & (2**64 - 1)): c for (i, f), c in got.items()} == want
    assert simhash.near_duplicates(docs(spark, texts)).count() == len(texts)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.dedup(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "fp", "anchor"] and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 6, 8]


def slow_cut(texts, length):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in texts]
    for i, w in words:
        for k in range(len(w) - length + 1):
            run = tuple(w[k : k + length])
            first[run] = min(i, first.get(run, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_digests(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "1", "2"])
    passages = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(5)]
    texts = []
    for i in rng.sample(range(1000), 40):
        w = [word() for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + [word() for _ in range(rng.randrange(5))]
        texts.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    texts += [(2000, "same " * 300), (2001, "same " * 200 + "b"), (2002, None), (2003, ""), (2004, texts[0][1]), (2005, texts[0][1]), (-1, texts[1][1])]
    got = sorted(map(tuple, substring.digests(docs(spark, texts), length=20).collect()))
    assert got == slow_cut(texts, 20)


def test_substring_cut_keeps_spacing_and_rows(spark):
    shared = " ".join(f"w{i}" for i in range(30))
    texts = [(1, shared), (2, f"before,\n{shared}\nafter  it"), (3, None), (None, shared), (4, "short"), (4, "short")]
    out = substring.cut(docs(spark, texts), length=20)
    assert out.columns == ["doc_id", "text", "fp", "anchor"]
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(1, shared), (2, "before,\nafter  it"), (3, ""), (0, shared), (4, "short"), (4, "short")])
    assert substring.cut(docs(spark, []), length=20).count() == 0


def test_substring_spans_go_by_row(spark):
    rng = random.Random(5)
    word = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n)]
    shared, other = word(60), word(60)
    long, short = word(200) + shared + word(20) + other[:40], other + word(3)
    texts = [(1, " ".join(word(5) + shared + word(5))), (2, " ".join(long)), (2, " ".join(short)), (3, " ".join(word(4) + other[10:] + word(9))), (4, " ".join(long[150:280]))]
    got = sorted(map(tuple, substring.digests(docs(spark, texts), length=20).collect()))
    assert got == slow_cut(texts, 20)


def sets_of(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_by_similarity(spark):
    rng = random.Random(9)
    texts = []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(words))
        for _ in range(4):  # copies on both sides of the threshold
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.uniform(0.0, 0.06)))):
                copy[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), None, "", " \t", "one", "one two"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, texts[7]), (7, texts[0]), (None, texts[3]), (None, "no id"), (None, "no id")]
    rng.shuffle(rows)
    sets = [sets_of(t) for _, t in rows]
    alike = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if alike(sets[i], sets[j])]
    groups = {}
    for n, r in brute_components(near, range(len(rows))).items():
        groups.setdefault(r, []).append(n)
    want = sorted(str(min((rows[n][0] for n in g if rows[n][0] is not None), default=None)) for g in groups.values())
    kept = minhash.dedup(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "anchor"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert minhash.dedup(docs(spark, [])).count() == 0


def test_a_large_group_costs_no_pairs(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):  # all near each other
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(120)]
    for i in range(12):  # each near the next only: a chain that leaders alone may not close
        words = list(chain)
        for k in range(i):
            words[k * 5 : k * 5 + 2] = [f"y{k}a", f"y{k}b"]
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    sizes = {}
    stored = minhash.materialize

    def counted(df, name):
        out = stored(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    kept = sorted(r.doc_id for r in minhash.dedup(docs(spark, rows)).collect())
    sets = [sets_of(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert len(near) > 10_000
    assert kept == sorted({rows[r][0] for r in brute_components(near, range(len(rows))).values()})
    assert sum(sizes["candidates"]) < 3_500


@pytest.mark.parametrize("rounds", [0, 3])
def test_what_stays_apart_in_a_group_is_compared(spark, monkeypatch, rounds):
    """Copies of one text with many changes, some of them shared by three; without rounds of leaders all links are found by narrow bands."""
    rng = random.Random(29)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(4, 14)):
            words[at] = f"v{i}-{at}"
        for _ in range(1 if i % 8 else 3):
            more = list(words)
            for at in rng.sample(range(150), rng.randrange(1, 4)):
                more[at] = f"u{rng.random()}"
            rows.append((len(rows), " ".join(more)))
    sizes, stored = {}, minhash.materialize

    def counted(df, name):
        out = stored(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    monkeypatch.setattr(minhash, "roots", functools.partial(minhash.roots, rounds=rounds))
    kept = sorted(r.doc_id for r in minhash.dedup(docs(spark, rows)).collect())
    sets = [sets_of(t) for _, t in rows]
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(rows)) for j in range(i + 1, len(rows))]
    near = [(i, j) for i, j, s in pairs if s >= 0.8 - 1e-9]
    assert kept == sorted({rows[r][0] for r in brute_components(near, range(len(rows))).values()})
    assert sizes["narrow"][0] >= minhash.NARROW * 100
    assert sizes["candidates"][-1] <= sum(s >= 0.6 for _, _, s in pairs)


def test_the_pipeline_drops_what_simhash_links_and_what_it_does_not(spark):
    import corpus_pipeline

    rng = random.Random(5)
    long = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    copies = [" ".join("x" if i % 40 == k % 40 and k else w for i, w in enumerate(long)) for k in range(4)]  # ten words each: some 0.76 alike in five-word shingles
    rows = [(i, t) for i, t in enumerate(copies)] + [(10 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(5)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    fps = [slow_fingerprint(t) for _, t in rows]
    bits = [(i, j) for i in range(9) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    alike = [(i, j) for i in range(9) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    # A pair that fingerprints alone link: one shingle is most of either text, and no set of shingles.
    base = "again " * 300
    rows += [(20, base + "one two three four five six seven eight"), (21, base + "nine ten eleven twelve thirteen fourteen")]
    assert (slow_fingerprint(rows[-1][1]) ^ slow_fingerprint(rows[-2][1])).bit_count() <= 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = brute_components([*bits, *alike, (9, 10)], range(len(rows)))
    want = sorted({rows[r][0] for r in groups.values()})
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()) == want
    assert 21 in {r.doc_id for r in minhash.dedup(frame).collect()}


def test_near_copies_leave_on_disk_only_what_their_result_reads(spark):
    place = f"{shared_dir(spark)}/llm"
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "x y z")], "doc_id long, text string")
    kept = minhash.dedup(docs, labels=simhash.labels)
    assert {name.split("-")[0] for name in set(os.listdir(place)) - before} == {"heads", "copies"}
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_keys_of_fingerprints_never_go_to_the_driver(spark):
    # A table of fingerprints is far below the size that Spark broadcasts, and its 64 keys a row are not.
    fps = [7, 7 ^ 1 << 63, 7 ^ 0b111, 1 << 40, 99, 98 ^ 1 << 40]
    frame = spark.createDataFrame([((f ^ 1 << 63) - (1 << 63),) for f in fps], "fp long")
    found = simhash.links(frame)
    pairs = {frozenset((r.u % 2**64, r.v % 2**64)) for r in found.collect()}
    assert pairs == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
