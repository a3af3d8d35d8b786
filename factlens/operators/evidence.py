"""Evidence tables for questions, and the contract check of answers that cite them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import defang, one_line

ANSWER = "answer string, citations array<string>, confidence string"


def build(questions: DataFrame, hits: DataFrame, n: int = 8, max_chars: int = 8000, snippet_chars: int = 400) -> DataFrame:
    """Ranked hits of each question as evidence 1..N within a budget of characters; a question without any keeps one row with
    status insufficient_evidence."""
    snippet = one_line(F.concat_ws(" — ", "title", "content"), snippet_chars)
    rows = hits.where(F.col("rank") <= n).withColumn("snippet", snippet)
    frame = W.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("used", F.sum(F.length("snippet") + 1).over(frame.rowsBetween(W.unboundedPreceding, 0))).where(F.col("used") <= max_chars)
    numbered = rows.withColumn("evidence_id", F.row_number().over(frame)).drop("used")
    out = questions.select("query_id").join(numbered, "query_id", "left")
    return out.withColumn("status", F.when(F.col("evidence_id").isNull(), "insufficient_evidence").otherwise("ok"))


def lines(evidence: DataFrame) -> DataFrame:
    """Adds line: a numbered line of metadata and snippet that cannot close the block it is quoted in."""
    part = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    about = F.concat_ws("; ", part("type", "unit_type"), part("document", "document_id"), part("entity", "entity"), part("metric", "metric"), part("period", "reporting_period"), part("status", "validation_status"))
    return evidence.withColumn("line", F.concat(F.lit("["), F.col("evidence_id").cast("string"), F.lit("] ("), defang(about), F.lit(") "), defang(F.col("snippet"))))


def conflicts(evidence: DataFrame) -> DataFrame:
    """(query_id, entity, metric, reporting_period, n_values, evidence_ids, line): keys for which the records among a question's evidence
    say different things. Evidence of a question is bounded by its number of rows, so the ids are too."""
    key = ("query_id", "entity", "metric", "reporting_period")
    said = evidence.where((F.col("unit_type") == "record") & (F.coalesce(F.trim("content"), F.lit("")) != "") & F.col("evidence_id").isNotNull())
    found = said.groupBy(*key).agg(F.array_sort(F.collect_set("content")).alias("values"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids")).where(F.size("values") > 1)
    numbers = F.array_join(F.transform("evidence_ids", lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), " ")
    about = F.concat_ws(" ", "entity", "metric", "reporting_period")
    line = F.concat(F.lit("conflict: "), defang(about), F.lit(": "), defang(F.array_join("values", " | ")), F.lit(" "), numbers)
    return found.select(*key, F.size("values").alias("n_values"), "evidence_ids", line.alias("line"))


def document_lines(units: DataFrame, snippet_chars: int = 400) -> DataFrame:
    """(document_id, n, line): the units of every document as numbered lines, for questions about a document rather than a search."""
    numbered = units.withColumn("snippet", one_line(F.concat_ws(" — ", "title", "content"), snippet_chars)).withColumn("evidence_id", F.row_number().over(W.partitionBy("document_id").orderBy("unit_id")))
    return lines(numbered).select("document_id", F.col("evidence_id").alias("n"), "line")


def check_answers(responses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Responses (query_id, response JSON): error (NULL if the keys and types are as agreed), valid and dropped citations."""
    parsed = F.from_json("response", ANSWER, {"mode": "PERMISSIVE"})
    keys = F.array_sort(F.json_object_keys("response"))
    wanted = F.array(F.lit("answer"), F.lit("citations"), F.lit("confidence"))
    known = evidence.where("evidence_id is not null").groupBy("query_id").agg(F.collect_set(F.col("evidence_id").cast("string")).alias("known"))
    joined = responses.join(known, "query_id", "left").withColumn("a", parsed).withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    # from_json turns a number, a list or an object into text where text is wanted; the JSON itself tells them apart.
    kinds = F.from_json("response", "answer variant, citations variant, confidence variant", {"mode": "PERMISSIVE"})
    kind = lambda c: F.schema_of_variant(F.col(f"k.{c}"))
    joined = joined.withColumn("k", kinds)
    fine = (kind("answer") == "STRING") & kind("citations").startswith("ARRAY<") & (kind("confidence") == "STRING")
    error = F.when(keys.isNull(), "not_json").when(keys != wanted, "keys").when(~F.coalesce(fine, F.lit(False)) | F.col("a.answer").isNull() | F.col("a.citations").isNull(), "types")
    cited = F.coalesce(F.transform("a.citations", lambda c: c.cast("string")), F.array().cast("array<string>"))
    return joined.select(
        "query_id", error.alias("error"), F.array_sort(F.array_intersect(cited, F.col("known"))).alias("citations"), F.array_sort(F.array_except(cited, F.col("known"))).alias("dropped"),
    )
