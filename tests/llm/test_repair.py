"""Repaired conversations against plain search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

from factlens.llm import repair

LEGAL = {"su", "ua", "au"}


def hurt(rows):
    for conv, turn, role, text in rows:
        named = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", named(text)) if kind == 2 else named(text)
        yield from [(conv, turn, "user" if kind == 4 else named(role), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def cheapest(rows):
    """(cost, audit, lines) by trying every edit at every place, least audit first."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            found.append(join(3, "D", None, best(i + 1, state, 3)))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] in step[state]:
                    found.append(join(extra, "K", f"{role}:{text}", best(i + 1, step[state][role[:1]], 3)))
                found += [join(2 + extra, "R", f"{name[x]}:{text}", best(i + 1, x, 3)) for x in "ua" if x in step[state]]
        if inserts:
            found += [join(2, "I", f"{name[x]}:", best(i, x, inserts - 1)) for x in "ua" if x in step[state]]
        return min(found, default=(10**9, "", ()))

    def join(cost, edit, line, rest):
        return (cost + rest[0], edit + rest[1], ((line,) if line is not None else ()) + rest[2])

    return best(0, "", 3)


def plain(rows, all_convs):
    out = {}
    for conv in all_convs:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faulty, n = set(), [], {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(tuple(faulty))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TEXTS = ["Yes.", "No!", "cut off", "", " \t", "Why?", None, "a.b", "..", "end. ", "é?"]


def invented(seed, convs, most):
    pick = random.Random(seed)
    rows = []
    for conv in convs:
        roles = ["system", "user", "assistant"] * 2 + ["tool", "", None]
        turn = 0
        for i in range(pick.randint(1, most)):
            turn += pick.choice([1, 1, 1, 1, 0, 2])
            rows.append((conv, pick.choice([turn] * 9 + [None]), pick.choice(roles if pick.random() < 0.4 else [["user", "assistant"][i % 2]]), pick.choice(TEXTS + [f"Text {i}."] * 12)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, part string, digest int").repartition(3)


def run(spark, rows):
    conversations = frame(spark, rows)
    return {r["conv_id"]: tuple(r) for r in repair.report(repair.damage(conversations), conversations).collect()}


def test_random_conversations_as_plain_search_repairs_them(spark):
    rows = invented(7, [*range(150), None], 9)
    want = plain(list(hurt(rows)), {r[0] for r in rows})
    assert run(spark, rows) == want
    assert {"D", "I", "K", "R"} <= set("".join(w[7] for w in want.values()))


def test_a_conversation_over_many_ranges(spark):
    """One with most rows goes over all ranges: chained matrices and exits give what a search over the whole gives."""
    rows = invented(3, [5], 60) + [(5, 100 + i, "user", f"Same run {i}.") for i in range(25)] + invented(4, [6, 7], 5)
    want = plain(list(hurt(rows)), {5, 6, 7})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repair.segments(repair.symbols(repair.ordered(repair.damage(frame(spark, rows))))).where("conv_id = 5").count() > 1
        assert run(spark, rows) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_split_runs_unroll_like_whole_ones():
    pick = random.Random(1)
    for _ in range(300):
        symbols = [pick.choice([0, 4, 8, 5, 9, 12, 14, 6]) for _ in range(pick.randint(1, 4))]
        runs = [(s, pick.choice([1, 2, 3, 7, 40])) for s in symbols]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        whole = repair.unroll(runs, 0, repair.END, True)
        assert whole == repair.unroll(single, 0, repair.END, True)
        assert whole[1] == repair._apply(repair.run_matrix(runs), repair.END)[0]
        for cut in range(1, len(single)):
            v = repair._apply(repair.run_matrix(single[cut:]), repair.END)
            first = repair.unroll(single[:cut], 0, v, False)
            second = repair.unroll(single[cut:], first[2], repair.END, True)
            assert (first[0] + second[0], first[1] + second[1]) == whole[:2]


def test_long_runs_are_not_walked_row_by_row_for_their_cost():
    assert repair._advance(4, 10**12, repair.END)[0] == 10**12  # every second one becomes an assistant


def test_repaired_turns_are_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "More."), (1, 2, "assistant", ""), (2, 0, "assistant", "Yes.")]
    got = sorted(tuple(r) for r in repair.repair(frame(spark, rows)).collect())
    audit = {1: cheapest((("user", "Hello.", ""), ("user", "More.", ""), ("assistant", "", "blank")))[1], 2: cheapest((("assistant", "Yes.", ""),))[1]}
    assert "".join(r[4] for r in got if r[0] == 1) == audit[1].replace("D", "")
    assert [(r[2], r[3]) for r in got if r[0] == 2] == ([] if audit[2] == "D" else [("user", ""), ("assistant", "Yes.")])


def test_empty_and_lost_conversations(spark):
    assert run(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == {gone: (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
