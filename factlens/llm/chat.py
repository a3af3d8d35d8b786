"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation becomes the prompt.

DataFrame functions only. Both conversations are arrays of (role, text) in turn order; the first place where they differ ends
the prompt, which is rendered once. What follows on either side is its completion, with the character ranges of the
completion that carry loss: the assistants' words and their end marks, not the headers and not what others say.

What looks like a mark in a role or a text can forge no turn: every `<|` of it is written `<||`, which no mark begins with and
which can be read back, and line ends in a role are blanks. Ranges count the characters as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, NEXT = "<|start|>", "<|end|>", "\n"
TRAINED = "assistant"


def _written(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _written(F.translate(turn["role"], "\r\n", "  ")), F.lit(NEXT))


def _rendered(turn: Column) -> Column:
    return F.concat(_header(turn), _written(turn["text"]), F.lit(CLOSE + NEXT))


def render(turns: Column) -> Column:
    """The text of an array of turns; empty for no turns."""
    return F.array_join(F.transform(turns, _rendered), "")


def loss_spans(turns: Column, trained: str = TRAINED) -> Column:
    """array<struct<start, end>>: character ranges [start, end) of render(turns) that carry loss."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(_header(turn))
        end = begin + F.length(_written(turn["text"])) + len(CLOSE)
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"))
        spans = F.when(turn["role"] == trained, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + len(NEXT)).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many turns the two arrays share from their start on."""
    n = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differs, True)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) in turn order.

    Null roles read `unknown`, null texts are empty, null turn numbers come first; turns of one number stand in order of
    role and text, and rows that are equal throughout count once. Turns without a conversation id are no conversation.
    """
    clean = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t"),
    )
    listed = clean.groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    return listed.select(F.col("id").alias(id_col), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replaces the two arrays of turns by prompt_turns, prompt, chosen_text, chosen_spans, rejected_text and rejected_spans.

    A null conversation counts as one without turns. If the one is a prefix of the other, its completion is empty; equal
    conversations are all prompt. The caller drops pairs without a difference, since they express no preference.
    """
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce(F.col(chosen), nothing), F.coalesce(F.col(rejected), nothing)
    cut = pairs.withColumn("prompt_turns", common_turns(a, b))
    rest = lambda x: F.slice(x, F.col("prompt_turns") + 1, F.greatest(F.size(x), F.lit(1)))
    out = cut.withColumn("__a", rest(a)).withColumn("__b", rest(b)).withColumn("prompt", render(F.slice(a, F.lit(1), F.col("prompt_turns"))))
    return out.select(
        *[c for c in pairs.columns if c not in (chosen, rejected)], "prompt_turns", "prompt",
        render(F.col("__a")).alias("chosen_text"), loss_spans(F.col("__a")).alias("chosen_spans"),
        render(F.col("__b")).alias("rejected_text"), loss_spans(F.col("__b")).alias("rejected_spans"),
    )


def degraded(turns: Column, seed: Column) -> Column:
    """A rejected conversation from a real one: from one of its trained turns on, those say the first half of their text only."""
    at = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull())
    start = F.try_element_at(at, (F.pmod(seed, F.greatest(F.size(at), F.lit(1))) + 1).cast("int"))
    half = lambda t: F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int"))
    return F.transform(
        turns, lambda t, i: F.struct(t["role"].alias("role"), F.when((i >= start) & (t["role"] == TRAINED), half(t)).otherwise(t["text"]).alias("text"))
    )


def op3_preference_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, each against a rejected one derived from it; masks as texts of ranges."""
    listed = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    pairs = listed.select("conv_id", F.col("turns").alias("chosen"), degraded(F.col("turns"), F.col("conv_id")).alias("rejected"))
    ranges = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    out = format_preferences(pairs)
    return out.select(
        "conv_id", "prompt_turns", "prompt", F.col("chosen_text"), ranges(F.col("chosen_spans")).alias("chosen_mask"),
        F.col("rejected_text"), ranges(F.col("rejected_spans")).alias("rejected_mask"),
    )


ORACLE = """
WITH clean AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         CASE WHEN role = 'assistant' THEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn NULLS FIRST, role, text) END AS k,
         count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS answers
  FROM clean),
starts AS (SELECT conv_id, min(i) AS start FROM placed WHERE k = ((conv_id % nullif(answers, 0)) + answers) % nullif(answers, 0) + 1 GROUP BY conv_id),
both_sides AS (
  SELECT p.conv_id, i, role, text AS a,
         CASE WHEN role = 'assistant' AND i >= start THEN substr(text, 1, (length(text) // 2)::INT) ELSE text END AS b
  FROM placed p LEFT JOIN starts USING (conv_id)),
cuts AS (SELECT conv_id, coalesce(min(i) FILTER (a <> b) - 1, count(*)) AS n FROM both_sides GROUP BY conv_id),
shown AS (
  SELECT s.conv_id, i, n, role, '<|start|>' || said || chr(10) || replace(a, '<|', '<||') || '<|end|>' || chr(10) AS ta,
         '<|start|>' || said || chr(10) || replace(b, '<|', '<||') || '<|end|>' || chr(10) AS tb, 10 + length(said) AS head
  FROM (SELECT *, replace(translate(role, chr(13) || chr(10), '  '), '<|', '<||') AS said FROM both_sides) s JOIN cuts USING (conv_id)),
spans AS (
  SELECT *, coalesce(sum(length(ta)) FILTER (i > n) OVER w, 0)::BIGINT AS ea, coalesce(sum(length(tb)) FILTER (i > n) OVER w, 0)::BIGINT AS eb
  FROM shown WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, any_value(n)::INT AS prompt_turns,
       coalesce(string_agg(ta, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
       coalesce(string_agg(ta, '' ORDER BY i) FILTER (i > n), '') AS chosen_text,
       coalesce(string_agg((ea - length(ta) + head) || '-' || (ea - 1), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(tb, '' ORDER BY i) FILTER (i > n), '') AS rejected_text,
       coalesce(string_agg((eb - length(tb) + head) || '-' || (eb - 1), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY conv_id
"""
