"""Repair of the structure of conversations: a run-length dynamic programme over roles and faults.

Every row of a conversation becomes a symbol: the initial of its role (system, user, assistant, other) and its first fault (blank, a copy of an
earlier row, cut off). A repaired conversation is empty or an optional system turn and pairs of user and assistant, which four states check: the start,
behind system, behind user, behind assistant. A symbol is a min-plus matrix over these states: keep, rerole, delete, and inserts before
it. Equal symbols in a row are one run; a run of n advances by the powers of two of its matrix, which are computed once and kept. Costs to go are
advanced from the end; then choices are unrolled from the front, a run by halves, always the first edit in ASCII order that stays cheapest.

Rows are dealt out by range of (conversation, turn), so a conversation with a third of all rows spreads over tasks. A segment (what a range holds of
a conversation) is stored as runs. Only the segments at the ends of a range may go on in another: two a range, whose 4 x 4 matrices, then
exits by entry state, the driver chains. Copies are found by a range partition by (conversation, role, text) that compares neighbours. Writing a
repaired conversation is a stream in order, since its digest is one; a task holds the audit of one conversation and a batch of rows.

Rows are ordered by turn, nulls first, and within a turn by role and the SHA-256 of the text; equal rows are copies of each other. Null roles
and texts are one space, a role of no known initial can only be reroled or deleted. A null conversation is one of its own. An empty
table has no conversations. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import materialize

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
CLASSES, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
#: Where an inserted or reroled turn leads, by state: to user, but behind user to assistant.
FORCED = (2, 2, 3, 2)
ROLES = (None, None, "user", "assistant")
LEGAL = {(0, 1), (1, 2), (2, 1)}
NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, min(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def _apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(NEVER, min(a[i][k] + v[k] for k in range(4))) for i in range(4))


def _inserts() -> Matrix:
    """Any number of inserts: two lead everywhere that inserts lead."""
    one = tuple(tuple(0 if i == j else INSERT if j == FORCED[i] else NEVER for j in range(4)) for i in range(4))
    return _times(one, one)


INSERTS = _inserts()
END: Vector = _apply(INSERTS, (0, NEVER, NEVER, 0))


@lru_cache(maxsize=None)
def _moves(symbol: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """By state: (edit, cost, next state) of a row with this symbol, in ASCII order of edits. There are 16 symbols."""
    kind, fault = symbol >> 2, symbol & 3
    out = []
    for q in range(4):
        here = [("D", DELETE, q)]
        if fault < 2:
            to = {0: 1 if q == 0 else None, 1: 2 if q != 2 else None, 2: 3 if q == 2 else None}.get(kind)
            if to is not None:
                here.append(("K", KEEP + fault, to))
            here.append(("R", REROLE + fault, FORCED[q]))
        out.append(tuple(here))
    return tuple(out)


@lru_cache(maxsize=None)
def _power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2**bit rows with this symbol."""
    if bit:
        half = _power(symbol, bit - 1)
        return _times(half, half)
    row = [[NEVER] * 4 for _ in range(4)]
    for q, moves in enumerate(_moves(symbol)):
        for _, cost, to in moves:
            row[q][to] = min(row[q][to], cost)
    return _times(INSERTS, tuple(map(tuple, row)))


def _advance(symbol: int, n: int, v: Vector) -> Vector:
    """Costs to go before n rows with this symbol, from those behind them."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            v = _apply(_power(symbol, bit), v)
    return v


def run_matrix(runs: list[tuple[int, int]]) -> Matrix:
    out: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
    for symbol, n in runs:
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                out = _times(out, _power(symbol, bit))
    return out


def _unroll_run(symbol: int, n: int, q: int, v: Vector) -> tuple[str, int, int]:
    """(edits, cost, state behind) of a run from state q, where v, less its least value, are the costs to go behind it."""
    if n == 1:
        return _unroll_one(symbol, q, v)
    half = 1 << (n.bit_length() - 1 if n & (n - 1) else n.bit_length() - 2)
    first, cost, q = _unroll_run(symbol, half, q, _level(_advance(symbol, n - half, v)))
    rest, more, q = _unroll_run(symbol, n - half, q, v)
    return first + rest, cost + more, q


@lru_cache(maxsize=1 << 16)
def _unroll_one(symbol: int, q: int, v: Vector) -> tuple[str, int, int]:
    here, edits, cost = _apply(_power(symbol, 0), v), "", 0
    while True:
        for edit, price, to in sorted([*_moves(symbol)[q], ("I", INSERT, FORCED[q])]):
            if price + (here[to] if edit == "I" else v[to]) == here[q]:
                break
        edits, cost, q = edits + edit, cost + price, to
        if edit != "I":
            return edits, cost, q


def _level(v: Vector) -> Vector:
    least = min(v)
    return tuple(x - least for x in v)


def unroll(runs: list[tuple[int, int]], q: int, v: Vector, closes: bool) -> tuple[str, int, int]:
    """(edits, cost, state behind) of a segment from state q with costs to go v behind it; closes: nothing of the conversation follows."""
    behind = []
    for symbol, n in reversed(runs):
        behind.append(_level(v))
        v = _advance(symbol, n, v)
    edits, total = [], 0
    for (symbol, n), after in zip(runs, reversed(behind)):
        found, cost, q = _unroll_run(symbol, n, q, after)
        edits.append(found)
        total += cost
    while closes and q in (1, 2):
        edits.append("I")
        total, q = total + INSERT, FORCED[q]
    return "".join(edits), total, q


def _pack(runs: list[tuple[int, int]]) -> bytes:
    return b"".join(struct.pack("<BQ", *r) for r in runs)


def _unpack(data: bytes) -> list[tuple[int, int]]:
    return list(struct.iter_unpack("<BQ", data))


def ordered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as this module reads them: (conv_id, turn, role, text, digest)."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, symbol) of ordered() rows: 4 times the role's number and the fault's."""
    flat = rows.select("conv_id", "turn", "role", "digest", (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("open"))
    ranged = materialize(flat.repartitionByRange("conv_id", "role", "digest", "turn").withColumn("part", F.spark_partition_id()), "copies")
    key = F.struct("conv_id", "role", "digest")
    # What closes the range before, by range: as many rows as there are ranges.
    handed = ranged.groupBy("part").agg(F.max(key).alias("last")).withColumn("handed", F.lag("last").over(W.orderBy("part"))).select("part", "handed")
    placed = ranged.join(F.broadcast(handed), "part").withColumn("key", key)
    before = F.coalesce(F.lag("key").over(W.partitionBy("part").orderBy(*[F.asc_nulls_first(c) for c in ("conv_id", "role", "digest", "turn")])), F.col("handed"))
    kind = reduce(lambda at, i: F.when(F.substring("role", 1, 1) == CLASSES[i], i).otherwise(at), range(3), F.lit(3))
    fault = F.when(F.col("blank"), 2).when(F.col("key").eqNullSafe(F.col("before")), 3).when(F.col("open"), 1).otherwise(0)
    return placed.withColumn("before", before).select("conv_id", "turn", "role", "digest", (kind * 4 + fault).cast("int").alias("symbol"))


class _Segment:
    def __init__(self, conv, part: int) -> None:
        self.conv, self.part, self.runs = conv, part, []
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.least = self.most = self.first_turn = self.last_turn = self.last = None
        self.head = None

    def add(self, turn, symbol: int) -> None:
        if self.last is None:
            self.head, self.first_turn = symbol >> 2, turn
        else:
            self.illegal += (self.last, symbol >> 2) not in LEGAL
        if turn is not None:
            self.turns += self.most is None or turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.last, self.last_turn = symbol >> 2, turn
        self.faults[symbol & 3] += 1
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + 1)
        else:
            self.runs.append((symbol, 1))

    def row(self, opens: bool, closes: bool) -> tuple:
        matrix = [x for line in run_matrix(self.runs) for x in line] if opens or closes else None
        return (self.conv, self.part, opens, closes, _pack(self.runs), matrix, *self.faults[1:], self.illegal, self.head, self.last, self.first_turn, self.last_turn, self.least, self.most, self.turns)


SEGMENT = "part int, opens boolean, closes boolean, runs binary, matrix array<bigint>, truncated bigint, blank bigint, duplicate bigint, illegal bigint, head int, tail int, first_turn bigint, last_turn bigint, least bigint, most bigint, turns bigint"
REPORT = "truncated bigint, blank bigint, duplicate bigint, illegal bigint, cost bigint, least bigint, most bigint, turns bigint"


def _arrow(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(like)], schema=like)


def _schema(frame_schema, ddl: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType([frame_schema["conv_id"], *StructType.fromDDL(ddl)])
    return full, to_arrow_schema(full)


def segments(marked: DataFrame) -> DataFrame:
    """One row for what a range of (conv_id, turn) holds of a conversation, in order of `part`: its runs and what is counted in it; with its
    matrix, if it stands at an end of the range. Stored."""
    order = ["conv_id", "turn", "role", "digest"]
    ranged = materialize(marked.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    schema, arrow = _schema(marked.schema, SEGMENT)

    def scan(batches):
        out, now, opens = [], None, True
        for b in batches:
            part, conv, turn, symbol = (b.column(i).to_pylist() for i in range(4))
            for p, c, t, s in zip(part, conv, turn, symbol):
                if now is None or p != now.part or c != now.conv:
                    if now is not None:
                        out.append(now.row(opens, p != now.part))
                        opens = p != now.part
                    now = _Segment(c, p)
                now.add(t, s)
            if len(out) >= 5000:
                yield _arrow(out, arrow)
                out = []
        if now is not None:
            out.append(now.row(opens, True))
        if out:
            yield _arrow(out, arrow)

    sorted_rows = ranged.repartition("part").sortWithinPartitions("part", *[F.asc_nulls_first(c) for c in order]).select("part", "conv_id", "turn", "symbol")
    return materialize(sorted_rows.mapInArrow(scan, schema), "segments")


def _linked(found: DataFrame) -> dict[tuple[int, bool], tuple]:
    """(part, opens) -> (entry state, costs to go, closes, tail and turn before) of segments whose conversation goes over several ranges.
    To the driver come two rows a range at most."""
    ends = found.where("opens or closes")
    chains: list[list] = []
    for r in ends.drop("runs").orderBy("part", F.desc("opens")).collect():
        last = chains[-1][-1] if chains else None
        if last is not None and last["part"] != r["part"] and last["conv_id"] == r["conv_id"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    ahead: dict[tuple[int, bool], Vector] = {}
    for chain in chains:
        v = END
        for r in reversed(chain):
            ahead[r["part"], r["opens"]] = v
            v = _apply(tuple(tuple(r["matrix"][4 * i : 4 * i + 4]) for i in range(4)), v)
    if not chains:
        return {}
    shared = found.sparkSession.sparkContext.broadcast(ahead)

    def leave(batches):
        for b in batches:
            for part, opens, runs in zip(*(b.column(i).to_pylist() for i in range(3))):
                v = shared.value.get((part, opens))
                if v is not None:
                    yield pa.RecordBatch.from_pydict({"part": [part], "opens": [opens], "exits": [[unroll(_unpack(runs), q, v, False)[2] for q in range(4)]]}, pa.schema([("part", pa.int32()), ("opens", pa.bool_()), ("exits", pa.list_(pa.int32()))]))

    exits = {(r["part"], r["opens"]): r["exits"] for r in ends.select("part", "opens", "runs").mapInArrow(leave, "part int, opens boolean, exits array<int>").collect()}
    out = {}
    for chain in chains:
        q, tail, turn = 0, None, None
        for r in chain:
            at = r["part"], r["opens"]
            out[at] = q, ahead[at], r is chain[-1], tail, turn
            q, tail, turn = exits[at][q], r["tail"], r["last_turn"]
    return out


def edits(found: DataFrame) -> DataFrame:
    """(conv_id, part, edits, counts and cost) of segments()."""
    shared = found.sparkSession.sparkContext.broadcast(_linked(found))
    schema, arrow = _schema(found.schema, "part int, edits string, " + REPORT)

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                q, v, closes, tail, turn = shared.value.get((r["part"], r["opens"]) if r["opens"] or r["closes"] else None, (0, END, True, None, None))
                audit, cost, _ = unroll(_unpack(r["runs"]), q, v, closes)
                across = tail is not None and (tail, r["head"]) not in LEGAL
                again = turn is not None and turn == r["first_turn"]
                out.append((r["conv_id"], r["part"], audit, r["truncated"], r["blank"], r["duplicate"], r["illegal"] + across, cost, r["least"], r["most"], r["turns"] - again))
            yield _arrow(out, arrow)

    return found.mapInArrow(run, schema)


class _Writer:
    """The repaired rows of one conversation, from its audit and its rows in order."""

    def __init__(self, conv) -> None:
        self.conv, self.parts, self.at, self.state = conv, [], 0, 0
        self.audit = None
        self.sums, self.least, self.most = [0] * 6, None, None

    def segment(self, audit: str, numbers: list, least, most) -> None:
        self.parts.append(audit)
        self.sums = [a + b for a, b in zip(self.sums, numbers)]
        self.least = least if self.least is None else self.least if least is None else min(least, self.least)
        self.most = most if self.most is None else self.most if most is None else max(most, self.most)

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = FORCED[self.state]
            yield "I", ROLES[self.state], ""

    def close(self):
        if self.audit is None:
            self.audit = "".join(self.parts)
        yield from self._inserted()

    def turn(self, role: str, text: str):
        yield from self.close()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield edit, role, text
        elif edit == "R":
            self.state = FORCED[self.state]
            yield edit, ROLES[self.state], text


def _written(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits before rows, conversation by conversation, each in order. Every conversation of `rows` is there, also one whose rows all went."""
    number = [c for c in audits.columns if c not in ("conv_id", "part", "edits")]
    return (
        audits.withColumn("kind", F.lit(0)).unionByName(rows.select("conv_id", "turn", "role", "text", "digest", F.lit(1).alias("kind")), allowMissingColumns=True)
        .repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", "kind", "part", "turn", "role", "digest")])
        .select("conv_id", "kind", "edits", "role", "text", *number)
    )


def _stream(batches):
    """(writer, (edit, role, text) or None at its end) of the rows of _written()."""
    now = None
    for b in batches:
        conv, kind, audit, role, text = (b.column(i).to_pylist() for i in range(5))
        numbers = [b.column(i).to_pylist() for i in range(5, b.num_columns)]
        for i, c in enumerate(conv):
            if now is None or c != now.conv:
                if now is not None:
                    yield from ((now, x) for x in now.close())
                    yield now, None
                now = _Writer(c)
            if kind[i] == 0:
                *sums, least, most, turns = (x[i] for x in numbers)
                now.segment(audit[i], [*sums, turns], least, most)
            elif kind[i] == 1:
                yield from ((now, x) for x in now.turn(role[i], text[i]))
    if now is not None:
        yield from ((now, x) for x in now.close())
        yield now, None


def repair(rows: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, place, role, text, edit) of the repaired conversations: kept and reroled turns with their texts, inserted ones without."""
    good = ordered(rows, **columns)
    schema, arrow = _schema(good.schema, "place bigint, role string, text string, edit string")

    def run(batches):
        out, place, of = [], 0, None
        for writer, x in _stream(batches):
            place = 0 if writer is not of else place
            of = writer
            if x is not None:
                out.append((writer.conv, place, x[1], x[2], x[0]))
                place += 1
            if len(out) >= 1000:
                yield _arrow(out, arrow)
                out = []
        if out:
            yield _arrow(out, arrow)

    return _written(good, edits(segments(symbols(good)))).mapInArrow(run, schema)


def report(rows: DataFrame, conversations: DataFrame | None = None, **columns: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): faults, cheapest edits and the digest of the repaired
    `role:text` lines; also of `conversations` (conv_id) that have no rows."""
    good = ordered(rows, **columns)
    audits = edits(segments(symbols(good)))
    if conversations is not None:
        audits = audits.unionByName(conversations.select("conv_id").distinct().withColumn("edits", F.lit("")).withColumns({c: F.lit(0).cast("long") for c in ("truncated", "blank", "duplicate", "illegal", "cost", "turns")}), allowMissingColumns=True)
    schema, arrow = _schema(good.schema, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")

    def run(batches):
        out, digest, of = [], hashlib.sha256(), None
        for writer, x in _stream(batches):
            if x is not None:
                if writer is of:
                    digest.update(b"\n")
                digest.update(f"{x[1]}:{x[2]}".encode("utf-8", "surrogatepass"))
                of = writer
                continue
            truncated, blank, duplicate, illegal, cost, turns = writer.sums
            gaps = 0 if writer.least is None else writer.most - writer.least + 1 - turns
            out.append((writer.conv, gaps, blank, duplicate, truncated, illegal, cost, writer.audit, digest.hexdigest()))
            digest, of = hashlib.sha256(), None
            if len(out) >= 5000:
                yield _arrow(out, arrow)
                out = []
        if out:
            yield _arrow(out, arrow)

    return _written(good, audits).mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the contract's damage: by crc32 of `conv_id:turn` rows go, lose text or ends, repeat or turn to user."""
    space: Column = F.lit(" ")
    named = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind")).where("kind != 0")
    hurt = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return hurt.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op13_run_length_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all conversations, damaged, with the report of their repair."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damage(conversations), conversations)
