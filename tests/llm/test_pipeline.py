"""The pipeline, stage by stage, against brute force over what the stage before kept."""

import math
import random
import zlib

import numpy as np
from test_near_copies import brute_components, sets_of, slow_cut

import corpus_pipeline
from factlens.llm import mixing, packing

INSULTS = ["grobulax", "snerfling", "wuzzok"]


def tables(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    passage = [word() for _ in range(70)]
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randrange(20, 160))]
        if i % 6 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        if i % 10 == 3:
            words[5:5] = passage
        rows.append((i, " ".join(words), "en", f"s{i % 3}", len(" ".join(words))))
        labels.append((i, 1, int(i % 6 == 0)))
    base = [r for r in rows if r[0] % 6 and r[0] % 10 != 3][:12]
    for k, (_, text, lang, source, n) in enumerate(base):  # exact copies, near copies, and copies under an old id
        words = text.split()
        words[len(words) // 2] = "otherword"
        rows += [(300 + k, text, lang, source, n), (400 + k, " ".join(words), lang, source, n)]
    rows += [(500, None, "en", "s0", 0), (501, "", "en", None, 0), (1, "another text under an id that is taken", "en", "s1", 0), (None, "a text without an id", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")


def test_each_stage_by_brute_force(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/stage-{n}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        before, after = ([tuple(r) for r in df.collect()] for df in (docs, out))
        if n < 4:
            assert out.columns == columns
        if name == "toxicity":
            bad = {r for r in before if any(x in (r[1] or "") for x in INSULTS)}
            assert sorted(map(str, set(before) - bad)) == sorted(map(str, after))
        if name == "simhash_near_dedup":
            sets = [sets_of(r[1]) for r in before]
            near = [(i, j) for i in range(len(before)) for j in range(i + 1, len(before)) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
            groups = {}
            for i, r in brute_components(near, range(len(before))).items():
                groups.setdefault(r, []).append(before[i])
            assert sorted(str(min((r[0] for r in g if r[0] is not None), default=None)) for g in groups.values()) == sorted(str(r[0]) for r in after)
            assert set(after) <= set(before) and len(before) - len(after) >= 24
        if name == "substring_dedup":
            with_id = [(r[0], r[1]) for r in before if r[0] is not None]
            want = sorted((i, n_words - gone, sha) for i, n_words, gone, sha in slow_cut(with_id, 50))
            import hashlib

            got = sorted((r[0], len((r[1] or "").encode().split()), hashlib.sha256(b" ".join((r[1] or "").encode().split())).hexdigest()) for r in after if r[0] is not None)
            assert got == want and len(after) == len(before)
            assert sum(r[1] for r in want) < sum(len((t or "").split()) for _, t in with_id) - 500
        if name == "mixing":
            words = lambda rows, s: sum(len((r[1] or "").split()) for r in rows if r[3] == s)
            targets = {r["source"]: r["target"] for r in mixing.sources(docs.select("source", mixing.word_count(docs.text).alias("size"))).collect()}
            for s in targets:
                longest = max(len((r[1] or "").split()) for r in before if r[3] == s)
                assert abs(words(after, s) - targets[s]) <= longest / 2 + 1
                assert words(after, s) <= 2 * words(before, s)
            full = {s for s in targets if targets[s] >= words(before, s)}
            assert set(map(str, after)) <= set(map(str, before)) and {str(r) for r in before if r[3] in full or not r[1]} <= set(map(str, after))
        if name == "best_fit_packing":
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(packing.tokenizer_path())
            ids = [(r[0], model.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in before]
            want = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids if len(x) <= 1024)
            rows = out.collect()
            assert sorted((str(r.doc_id), r.length, r.ids_crc32) for r in rows) == want and all(len(x) <= 1024 for _, x in ids)
            places = {}
            for r in rows:
                places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for p in places.values():
                p.sort()
                assert [o for o, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1]) and sum(n for _, n in p) <= 1024
            assert len(places) <= math.ceil(sum(len(x) for _, x in ids) / 1024) + 1
        docs = out


def test_run_is_the_stages_in_a_row(spark, tmp_path):
    tables(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
