"""Registered queries, second part: stored tables, extraction, units, reports and scalar functions, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as N
from ..operators import analytics as A, conflicts as C, dashboard as D, embed, evidence as E, insights as I, records as R, report, search as S, text as T, units as U, validate as V
from ..sources import adapters as IN, extract as X, lifecycle as L, tables
from ..sources.store import Store
from . import analysis
from .queries import BASE, BINS, CONF, DEC, OUTCOMES, REC, SAID, SIDES, STATS, TOK, TREND, _cells, _classified, _config, _corpus, _d, _outcomes, _page_units, _scratch, query

# --- stored tables -----------------------------------------------------------------------------------------------------


@query(f"""WITH {REC} SELECT document_id, count(*) AS n, max(entity) AS last FROM rec GROUP BY document_id""")
def stored_table(spark, sf_dir):
    root = _scratch(spark)
    tables.write(IN.records_from_orders(spark, sf_dir), root, "records")
    rows = tables.read(spark, root, "records", ["document_id", "entity"])
    return rows.groupBy("document_id").agg(F.count("*").alias("n"), F.max("entity").alias("last"))


@query(f"""WITH {REC}, kept AS (SELECT record_id, document_id, 0 AS extra FROM rec WHERE document_id % 3 <> 0 AND document_id % 7 <> 1
UNION ALL SELECT record_id, document_id, 1 FROM rec WHERE document_id % 3 = 0 AND document_id % 7 <> 1 AND record_id % 4 = 0)
SELECT document_id, count(*) AS n, sum(extra)::BIGINT AS replaced FROM kept GROUP BY document_id""")
def stored_replace(spark, sf_dir):
    # An empty first run, all records, a third of the documents by a part of their records, and a seventh of them by nothing; both tables by each run.
    rows = IN.records_from_orders(spark, sf_dir).select("record_id", "document_id", F.lit(0).alias("extra"))
    count = lambda df: df.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("extra").alias("replaced"))
    store = Store(spark, _scratch(spark), {"records": rows.schema, "totals": count(rows).schema}, buckets=16)
    run = lambda name, df, keys=None: store.commit({"records": df, "totals": count(df)}, name, keys)
    run("none", rows.limit(0))
    run("all", rows)
    some = rows.where("document_id % 3 = 0")
    run("some", some.where("record_id % 4 = 0").withColumn("extra", F.lit(1)), some.select("document_id"))
    run("gone", rows.limit(0), rows.where("document_id % 7 = 1").select("document_id"))
    store.rebucket(4, "fewer")
    store.vacuum()
    state = store.state()
    return count(store.read("records", state)).join(store.read("totals", state), ["document_id", "n", "replaced"], "full")


@query("""SELECT event_type AS action, 'event' AS entity_type, '{"n":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' AS details FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY event_type""")
def audit_trail(spark, sf_dir):
    path, events = f"{_scratch(spark)}/audit", spark.read.parquet(f"{sf_dir}/events.parquet")
    actions = [r["event_type"] for r in events.select("event_type").distinct().orderBy("event_type").limit(3).collect()]
    for action in actions:
        counted = events.where(F.col("event_type") == action).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
        L.audit_append(L.audit_row(spark, action, "event", counted), path)
    return L.audit_view(spark.read.parquet(path), actions[0]).select("action", "entity_type", "details")


@query("""WITH e AS (SELECT event_id, user_id, event_type, event_id % 16 AS bucket FROM events), kept AS (SELECT * FROM e WHERE bucket % 4 <> 0 OR event_id % 3 = 0)
SELECT count(*) AS n, count(*) > 0 AS events_close, count(DISTINCT user_id) > 0 AS users_close, count(DISTINCT event_type) AS types FROM kept""")
def sketched_counts(spark, sf_dir):
    # A quarter of the buckets is replaced by a third of its events; estimates are held against exact counts.
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("bucket", F.col("event_id") % 16)
    columns, touched = ["event_id", "user_id", "event_type"], spark.range(0, 16, 4).select(F.col("id").alias("bucket"))
    changed = events.where("bucket % 4 = 0 and event_id % 3 = 0")
    path = f"{_scratch(spark)}/sketches"
    D.distinct_sketches(events, "bucket", columns).write.parquet(path)
    total = D.distinct_totals(D.refreshed(spark.read.parquet(path), D.distinct_sketches(changed, "bucket", columns), touched, "bucket"), columns)
    exact = events.where("bucket % 4 <> 0 or event_id % 3 = 0").agg(F.countDistinct("event_id").alias("a"), F.countDistinct("user_id").alias("b"))
    close = lambda c, x: F.abs(F.col(c) - F.col(x)) <= 0.04 * F.col(x)
    return total.crossJoin(exact).select(F.col("rows").alias("n"), close("event_id", "a").alias("events_close"), close("user_id", "b").alias("users_close"), F.col("event_type").alias("types"))  # one row each


@query("""SELECT event_type AS action, max(event_id) AS audit_id FROM events GROUP BY event_type, event_id QUALIFY row_number() OVER (ORDER BY max(ts) DESC, event_id DESC) <= 8""")
def recent_activity(spark, sf_dir):
    trail = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("action"), F.col("event_id").alias("audit_id"), F.col("ts").alias("created_at"))
    return D.recent_activity(trail).select("action", "audit_id")


SUMMARY_LINES = """c AS (SELECT count(*) AS n, count(DISTINCT document_id) AS d, count(*) FILTER (validation_status = 'warning') AS w, count(*) FILTER (validation_status = 'pending') AS p FROM rec),
e AS (SELECT string_agg(entity, ', ' ORDER BY entity) AS names FROM (SELECT DISTINCT entity FROM rec ORDER BY entity LIMIT 20)),
l AS (SELECT [n || ' records of ' || d || ' documents are selected; ' || n || ' have a value.', 'Entities: ' || names || '.', 'Metrics: order_total, priority_rank.',
  'REVIEW REQUIRED: ' || (SELECT count(*) FROM conf) || ' keys have different values; all are listed, none was chosen.', w || ' records have a warning, an error or await review.',
  p || ' records are not validated yet.', 'The listing is PARTIAL: it shows the first 100 records in order.'] AS l FROM c, e)"""


@query(f"""WITH {REC}, {CONF}, {SUMMARY_LINES}, named AS (SELECT *, entity || '|' || metric || '|' || reporting_period || '|' || unit AS key FROM rec)
SELECT 'detail' AS section, record_id::VARCHAR AS key, value_raw || ' ' || unit AS said FROM rec
UNION ALL SELECT 'key_figures', key, count(*)::VARCHAR FROM named GROUP BY key
UNION ALL SELECT 'sources', document_id::VARCHAR, count(*)::VARCHAR FROM rec GROUP BY document_id
UNION ALL SELECT 'validation_notes', validation_status, count(*)::VARCHAR FROM rec GROUP BY validation_status
UNION ALL SELECT 'summary', 'records', count(*)::VARCHAR FROM rec
UNION ALL SELECT 'conflicts', key || '|' || value_raw, min(record_id)::VARCHAR FROM named JOIN conf USING (entity, metric, reporting_period, unit) GROUP BY key, value_raw
UNION ALL SELECT 'executive_summary', i::VARCHAR, l[i + 1] FROM l, generate_series(0, 5) AS g(i)""")
def json_sink(spark, sf_dir):
    # Every line of every section is read again from the JSON that was written.
    path = f"{_scratch(spark)}/report"
    report.write_json(report.sections(IN.records_from_orders(spark, sf_dir), IN.documents(spark, sf_dir)), path)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    named = F.concat_ws("|", *[field(c) for c in ("entity", "metric", "reporting_period", "unit", "value_raw")])
    keys = {"detail": field("record_id"), "sources": field("document_id"), "validation_notes": field("validation_status"), "summary": F.lit("records"), "executive_summary": field("n")}
    said = {"detail": field("value_text"), "key_figures": field("n"), "sources": field("n_records"), "validation_notes": field("n"), "summary": field("records"), "conflicts": field("first_record_id"), "executive_summary": field("line")}
    of = lambda parts: F.coalesce(*[F.when(F.col("section") == name, c) for name, c in parts.items()])
    return spark.read.text(path).select("section", F.coalesce(of(keys), named).alias("key"), of(said).alias("said"))


# --- extraction --------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_orderkey AS document_id, count(*) AS n, string_agg(l_linenumber || chr(9) || coalesce(l_returnflag, '') || chr(9) || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS t FROM lineitem GROUP BY 1)
SELECT document_id, n::INT AS row_count, 3::INT AS column_count, CASE WHEN n * 3 > 15 THEN 'failed' ELSE 'extracted' END AS extraction_status, CASE WHEN n * 3 <= 15 THEN md5(t) END AS text_md5,
       CASE WHEN n * 3 > 15 THEN 'more than 15 cells' END AS error FROM g""")
def sheet_units(spark, sf_dir):
    row = F.struct("l_linenumber", "l_partkey", F.array(F.col("l_linenumber").cast("string"), F.coalesce("l_returnflag", F.lit("")), F.col("l_partkey").cast("string")).alias("cells"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    grids = lines.select("document_id", F.transform("r", lambda x: x["cells"]).alias("grid"))
    return X.sheet_units(grids, 15).select("document_id", "row_count", "column_count", "extraction_status", F.md5("extracted_text").alias("text_md5"), "error")


LINES = """line AS (SELECT doc_id AS document_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL)"""


@query(f"""WITH {LINES}, k AS (SELECT *, ord % 4 = 3 AS is_table, lag(ord % 4 = 3, 1, true) OVER (PARTITION BY document_id ORDER BY ord) AS behind FROM line),
s AS (SELECT *, sum(CASE WHEN is_table OR behind THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section_index FROM k)
SELECT document_id, section_index::BIGINT AS section_index, CASE WHEN bool_or(is_table) THEN 'table' ELSE 'paragraph' END AS kind,
       md5(coalesce(string_agg(CASE WHEN ord % 5 = 1 AND NOT is_table THEN '[Heading 2] ' || t ELSE t END, chr(10) ORDER BY ord) FILTER (trim(t) <> ''), '')) AS text_md5 FROM s GROUP BY 1, 2""")
def sections(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    number = F.col("i") + 1
    kind = F.when(number % 4 == 3, "table").otherwise("paragraph")
    blocks = lines.select("document_id", number.alias("ord"), kind.alias("kind"), F.when((number % 5 == 1) & (kind != "table"), "Heading 2").alias("style"), "text", F.array(F.array("text")).alias("rows"))
    # A heading without words is no line: its style is dropped as the text is.
    blocks = blocks.withColumn("style", F.when(F.trim("text") != "", F.col("style")))
    return X.sections(blocks).select("document_id", F.col("section_index").cast("long").alias("section_index"), "kind", F.md5("extracted_text").alias("text_md5"))


@query("""WITH d AS (SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id AS page_id, 1::INT AS page_number FROM documents
WHERE doc_id = (SELECT max(doc_id) FROM labels WHERE toxic = 0 AND doc_id IN (SELECT doc_id FROM documents))""")
def document_content(spark, sf_dir):
    done = IN.documents(spark, sf_dir).where("status = 'processed'").agg(F.max("document_id")).first()[0]
    return X.content(IN.pages(spark, sf_dir), IN.documents(spark, sf_dir), done).select("page_id", "page_number")


@query("""WITH u AS (SELECT doc_id % 97 AS document_id, CASE WHEN length(trim(text)) >= 200 THEN 'extracted' ELSE 'ocr_required' END AS s FROM documents)
SELECT document_id, CASE WHEN min(s) = max(s) THEN min(s) ELSE 'mixed' END AS extraction_status FROM u GROUP BY 1""")
def document_status(spark, sf_dir):
    pages = IN.pages(spark, sf_dir).withColumn("document_id", F.col("document_id") % 97).withColumn("extraction_status", F.lit(None).cast("string"))
    return X.document_status(X.unit_status(pages, 200))


@query("""SELECT l_orderkey AS document_id, 'section 2, table ' || l_linenumber || ', row 1' AS source_reference, 'part-' || l_partkey AS entity, 'demo_table_value' AS metric,
       round(l_quantity::DECIMAL(20,4)::DOUBLE, 4) AS metric_value, 'unknown' AS unit, strftime(l_shipdate, '%Y-%m-%d') AS reporting_period, 'table_value' AS record_type FROM lineitem""")
def records_from_tables(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = F.array(F.concat(F.lit(" part-"), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("decimal(20,4)").cast("string"), F.lit("unknown"), F.date_format("l_shipdate", "dd/MM/yyyy"))
    header = F.array(*map(F.lit, ("Entity", "Quantity", "UOM", "Date")))
    table = F.array(F.struct(F.col("l_linenumber").cast("int").alias("table_index"), header.alias("headers"), F.array(cells).alias("rows")))
    out = R.from_tables(rows.select(F.col("l_orderkey").alias("document_id"), F.lit(2).alias("section_index"), table.alias("tables")))
    return out.select("document_id", "source_reference", "entity", "metric", _d("metric_value", 4), "unit", "reporting_period", "record_type")


def _recognised(spark, sf_dir) -> DataFrame:
    """Documents as recognised images: the confidence goes by the id, some are flagged, some have neither."""
    k = F.col("doc_id")
    ocr = F.struct(F.when(k % 5 != 0, (k % 100) / 100.0).alias("confidence"), (k % 7 == 0).alias("review_required"))
    status = F.element_at(F.array(*map(F.lit, ("ocr_extracted", "no_text", "failed", "extracted"))), (k % 4 + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(k.alias("page_id"), k.alias("document_id"), F.lit(1).alias("page_number"), F.lit("image").alias("content_type"), F.col("text").alias("extracted_text"), status.alias("extraction_status"), ocr.alias("ocr"))


SEEN = "seen AS (SELECT doc_id, text, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 100) / 100.0 END AS c, doc_id % 7 = 0 AS flagged FROM documents)"


@query(f"""WITH {SEEN} SELECT doc_id AS document_id, 'image 1' AS source_reference, md5(text) AS value_md5, c::DOUBLE AS confidence, c IS NULL OR flagged AS review_required FROM seen WHERE trim(text) <> ''""")
def records_from_ocr(spark, sf_dir):
    return R.from_ocr(_recognised(spark, sf_dir)).select("document_id", "source_reference", F.md5("value_raw").alias("value_md5"), "confidence", "review_required")


@query(f"""WITH {SEEN} SELECT doc_id AS document_id, CASE WHEN c < 0.7 THEN 'OCR_LOW_CONFIDENCE' ELSE 'OCR_REVIEW_FLAGGED' END AS rule_code, 'review_required' AS status FROM seen
WHERE doc_id % 4 <> 3 AND (c < 0.7 OR (c IS NULL AND flagged))""")
def validate_ocr_pages(spark, sf_dir):
    rows = V.ocr_candidates(_recognised(spark, sf_dir))
    return V.row_outcomes(rows, _config(), (V.Rule("row", V.ocr),)).select("document_id", "rule_code", "status")


@query("""WITH b AS (SELECT l_orderkey AS document_id, l_linenumber AS i, l_linestatus AS t, (l_partkey % 5) / 4.0 AS c FROM lineitem)
SELECT document_id, round(avg(c::DOUBLE), 4) AS confidence, count(*) FILTER (c < 0.7)::INT AS low, bool_or(c < 0.7) OR round(avg(c::DOUBLE), 4) < 0.7 AS review_required, string_agg(t, chr(10) ORDER BY i, t, c) AS text, least(count(*), 3)::INT AS boxes FROM b GROUP BY 1""")
def ocr_boxes(spark, sf_dir):
    box = F.struct(F.col("l_linenumber").alias("i"), F.col("l_linestatus").alias("text"), ((F.col("l_partkey") % 5) / 4.0).alias("confidence"))
    grouped = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    out = grouped.select("document_id", N.ocr_summary(F.col("boxes"), keep=3).alias("o"))
    return out.select("document_id", "o.confidence", "o.low", "o.review_required", "o.text", F.size("o.boxes").alias("boxes"))


# --- scalar functions --------------------------------------------------------------------------------------------------


@query(r"""WITH e AS (SELECT event_id, event_type, ts, props FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day, event_type || ' x' AS value,
       CASE WHEN length(event_type) > 6 THEN rtrim(left(event_type, 5)) || '…' ELSE event_type END AS line, coalesce(nullif(left(lower(event_type), 64), ''), 'unknown') AS record_type, json_extract_string(props, '$.k') AS k FROM e""")
def scalar_functions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.when(F.col("event_id") % 3 == 0, "31/02/2025").when(F.col("event_id") % 3 == 1, F.date_format("ts", "d.M.yyyy")).otherwise(F.date_format("ts", "yyyy/M/d"))
    wide = F.concat(F.lit("  "), F.col("event_type"), F.lit("  \n x "))
    return rows.select(
        "event_id", N.normalize_date(day).alias("day"), N.normalize_value(wide).alias("value"), N.one_line(F.concat(F.lit(" "), "event_type"), 6).alias("line"),
        N.record_type(F.concat(F.lit(" Demo_"), "event_type")).alias("record_type"), N.meta(F.col("props"), "k").alias("k"),
    )


# --- units, search, evidence -------------------------------------------------------------------------------------------


@query(f"""WITH {REC} SELECT 'page-' || doc_id AS unit_id, md5(source || '/' || doc_id || ' — page 1 | ' || text) AS input_md5 FROM documents
UNION ALL SELECT 'record-' || record_id, md5(entity || ' — ' || metric || ' | ' || value_raw || ' | ' || unit || ' | ' || reporting_period) FROM rec""")
def embedding_inputs(spark, sf_dir):
    units = _page_units(spark, sf_dir).unionByName(U.record_units(IN.records_from_orders(spark, sf_dir)))
    return U.embedding_inputs(units).select("unit_id", F.md5("input_text").alias("input_md5"))


def _toy_model():
    """A stand-in for a user's model: a vector of counts. It fails on texts that hold a certain word, to show a failed batch."""

    def encode(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e"))] for t in texts]

    return encode


@query("""WITH t AS (SELECT doc_id, left(source || '/' || doc_id || ' — page 1 | ' || text, 100) AS t FROM documents)
SELECT 'page-' || doc_id AS unit_id, length(t)::DOUBLE AS size, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS e, 'embedded' AS embedding_status FROM t""")
def embedded_units(spark, sf_dir):
    units = _page_units(spark, sf_dir)
    out = embed.attach(units, embed.run(units, _toy_model, max_chars=100))
    return out.select("unit_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("e"), "embedding_status")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id AS unit_id FROM r WHERE n <= 5""")
def embedding_targets(spark, sf_dir):
    units = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"))
    return embed.targets(units, 5).select("unit_id")


@query("""SELECT label % 7 AS embedding_model, count(*) AS units FROM embeddings GROUP BY 1""")
def embedding_models(spark, sf_dir):
    return D.models(IN.vector_units(spark, sf_dir).withColumn("embedding_model", F.col("label") % 7))


@query("SELECT count(*) AS units FROM documents WHERE doc_id % 3 + 1 = 2 AND source = (SELECT min(source) FROM documents)")
def units_of_page_number(spark, sf_dir):
    pages = IN.pages(spark, sf_dir).withColumn("page_number", (F.col("page_id") % 3 + 1).cast("int"))
    docs = IN.documents(spark, sf_dir)
    first = docs.agg(F.min("source")).first()[0]
    units = _page_units(spark, sf_dir).join(docs.select("document_id", "source"), "document_id")
    return S.filter_units(units, page_number=2, pages=pages, source=first).agg(F.count("*").alias("units"))


@query("""WITH u AS (SELECT doc_id, source, lower(source || '/' || doc_id || ' — page 1 ' || text) AS t FROM documents), h AS (SELECT *, count(*) OVER () AS total FROM u WHERE contains(t, 'the'))
SELECT doc_id AS document_id, 23.0::DOUBLE AS score, source || '/' || doc_id AS filename, 1::INT AS page_number, total FROM h ORDER BY doc_id LIMIT 10 OFFSET 10""")
def shaped_hits(spark, sf_dir):
    hits = S.lexical(_page_units(spark, sf_dir), [], ["the"], limit=10, offset=10, total=True)
    return S.shape(hits, IN.documents(spark, sf_dir), IN.pages(spark, sf_dir)).select("document_id", "score", "filename", "page_number", "total")


EVID = f"""ev AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY record_id) AS evidence_id FROM rec)"""


@query(f"""WITH {REC}, {EVID}, c AS (SELECT document_id AS query_id, entity, metric, reporting_period, count(DISTINCT value_raw) AS n_values, string_agg(DISTINCT evidence_id::VARCHAR, ',' ORDER BY evidence_id::VARCHAR) AS ids,
  string_agg(DISTINCT value_raw, ' | ' ORDER BY value_raw) AS vals FROM ev GROUP BY ALL HAVING count(DISTINCT value_raw) > 1)
SELECT query_id, entity, metric, reporting_period, n_values::INT AS n_values, ids, 'conflict: ' || entity || ' ' || metric || ' ' || reporting_period || ': ' || vals AS line FROM c""")
def evidence_conflicts(spark, sf_dir):
    rows = U.record_units(IN.records_from_orders(spark, sf_dir)).withColumn("query_id", F.col("document_id"))
    numbered = rows.withColumn("evidence_id", F.expr("row_number() over (partition by query_id order by record_id)"))
    pages = _page_units(spark, sf_dir).withColumns({"query_id": F.col("document_id"), "evidence_id": F.lit(0)})  # pages never conflict
    ids = F.array_join(F.array_sort(F.transform("evidence_ids", lambda i: i.cast("string"))), ",")
    return E.conflicts(numbered.unionByName(pages)).select("query_id", "entity", "metric", "reporting_period", "n_values", ids.alias("ids"), F.regexp_replace("line", r" \[[^|]*$", "").alias("line"))


@query(f"""WITH {REC}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY 'record-' || record_id) AS n FROM rec)
SELECT document_id, n::INT AS n, md5('[' || n || '] (type: record; document: ' || document_id || '; entity: ' || entity || '; metric: ' || metric || '; period: ' || reporting_period || '; status: ' || validation_status || ') ' || entity || ' — ' || metric || ' — ' || value_raw) AS line_md5 FROM n""")
def document_lines(spark, sf_dir):
    return E.document_lines(U.record_units(IN.records_from_orders(spark, sf_dir))).select("document_id", "n", F.md5("line").alias("line_md5"))


# --- reports -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {REC}, v AS (SELECT unnest([{{'f': 'entity', 'v': entity}}, {{'f': 'metric', 'v': metric}}, {{'f': 'reporting_period', 'v': reporting_period}}]) AS x FROM rec)
SELECT x.f AS field, x.v AS value, count(*) AS n FROM v GROUP BY ALL""")
def distinct_values(spark, sf_dir):
    return report.distinct_values(IN.records_from_orders(spark, sf_dir))


@query(f"""WITH {REC}, {CONF}, {SUMMARY_LINES}
SELECT unnest(generate_series(0, 6))::INT AS n, unnest(l) AS line FROM l""")
def executive_summary(spark, sf_dir):
    return report.executive_summary(IN.records_from_orders(spark, sf_dir), 100)


ANALYSIS = f"""{BASE}, {TREND}, {SIDES}, {BINS}, agg AS (
  SELECT metric, unit, reporting_period, sum(CASE WHEN lo = hi THEN lo END) AS total, min(CASE WHEN lo = hi THEN lo END) AS lowest, max(CASE WHEN lo = hi THEN lo END) AS highest, count(CASE WHEN lo = hi THEN 1 END) AS cells, bool_or(lo <> hi) AS bad FROM cell GROUP BY ALL),
flag AS (SELECT *, bad OR EXISTS (SELECT 1 FROM conf c WHERE c.metric = agg.metric AND c.unit = agg.unit) AS review FROM agg WHERE cells > 0),
out_ AS (SELECT DISTINCT entity, metric, unit FROM cls LEFT JOIN cell USING (entity, metric, unit, reporting_period) WHERE reason IS NOT NULL OR lo <> hi)"""


SCALED = "({} * 10000000000)::HUGEINT"
#: A quotient of whole numbers with six decimals, half away from zero, as plain text.
SIX = DEC.format("(sign({0}) * ((2 * abs({0}) + abs({1})) // (2 * abs({1}))))::DECIMAL(28,0) * 0.000001::DECIMAL(7,6)")
SECTION_STATUS = "CASE WHEN {} THEN 'REVIEW REQUIRED' ELSE 'OK' END AS status"


@query(f"""{ANALYSIS}, {SAID},
value AS (SELECT metric, unit, reporting_period, review, unnest(['Total', 'Average', 'Min', 'Max']) AS kpi,
  unnest([{DEC.format("total")}, {SIX.format(SCALED.format("total") + " // 10000", "cells")}, {DEC.format("lowest")}, {DEC.format("highest")}]) AS v FROM flag),
said_of AS (SELECT entity, metric, unit, reporting_period || ': ' || {DEC.format("lo")} AS line FROM cell WHERE lo = hi UNION ALL SELECT entity, metric, unit, gap || ': no record' FROM gaps),
lines AS (SELECT entity, metric, unit, string_agg(line, chr(10) ORDER BY line) AS body FROM said_of GROUP BY ALL),
moved AS (SELECT *, CASE WHEN n < 2 THEN 'n/a' WHEN a = 0 THEN {DEC.format("b - a")} || ' (no percentage from a base of 0)'
  ELSE {DEC.format("b - a")} || ' (' || {SIX.format("(" + SCALED.format("(b - a)") + " * 100000000)", SCALED.format("a"))} || '%)' END AS change FROM t),
drawn AS (SELECT 'line/' || metric || '/' || unit AS chart, entity AS series, lo::DOUBLE AS y FROM cell WHERE lo = hi UNION ALL SELECT 'line/' || metric || '/' || unit, entity, NULL FROM gaps
  UNION ALL SELECT 'bins/' || metric || '/' || unit, 'count', n::DOUBLE FROM bars UNION ALL SELECT 'compare/' || metric || '/' || unit, reporting_period, v::DOUBLE FROM sides JOIN comp USING (metric, unit, reporting_period))
SELECT 'kpi_summary' AS section, kpi || ' ' || metric || ' ' || reporting_period AS head, v AS body, unit, {SECTION_STATUS.format("review")} FROM value
UNION ALL (SELECT 'insights', kind, message, NULL, NULL FROM named ORDER BY kind_rank, message LIMIT 60)
UNION ALL SELECT 'trends', m.entity || ' — ' || m.metric || ' — ' || m.unit, l.body || chr(10) || 'change: ' || change, NULL, {SECTION_STATUS.format("o.entity IS NOT NULL")}
  FROM moved m JOIN lines l ON l.entity = m.entity AND l.metric = m.metric AND l.unit = m.unit LEFT JOIN out_ o ON o.entity = m.entity AND o.metric = m.metric AND o.unit = m.unit
UNION ALL SELECT 'comparisons', metric || ' ' || reporting_period || ' ' || entity, coalesce({DEC.format("v")}, 'no verified value'), unit, {SECTION_STATUS.format("n_valued < n_entities")} FROM sides JOIN comp USING (metric, unit, reporting_period)
UNION ALL SELECT 'comparisons', metric || ' ' || reporting_period || ' difference of verified values', {DEC.format("difference")}, unit, {SECTION_STATUS.format("n_valued < n_entities")} FROM comp WHERE difference IS NOT NULL
UNION ALL SELECT 'charts', chart || ' ' || series, count(*) || ' points, ' || count(*) FILTER (y IS NULL) || ' gaps', NULL, NULL FROM drawn GROUP BY chart, series""")
def analytic_sections(spark, sf_dir):
    """The whole contents of the five sections."""
    rows = IN.records_from_orders(spark, sf_dir)
    with analysis.analyze(rows) as tables_:
        made = report.analytic_sections(tables_)
        none = F.lit(None).cast("string")
        parts = [
            made["kpi_summary"].select(F.lit("kpi_summary").alias("section"), F.col("indicator").alias("head"), F.col("value").alias("body"), "unit", "status"),
            made["insights"].select(F.lit("insights").alias("section"), F.col("kind").alias("head"), F.col("message").alias("body"), none.alias("unit"), none.alias("status")),
            made["trends"].select(F.lit("trends").alias("section"), F.col("headline").alias("head"), F.array_join("lines", "\n").alias("body"), none.alias("unit"), "status"),
            made["comparisons"].select(F.lit("comparisons").alias("section"), F.concat_ws(" ", "metric", "reporting_period", "entity").alias("head"), F.col("value").alias("body"), "unit", "status"),
            made["charts"].select(F.lit("charts").alias("section"), F.concat_ws(" ", "chart", "series").alias("head"), F.format_string("%d points, %d gaps", "points", "gaps").alias("body"), none.alias("unit"), none.alias("status")),
        ]
        place = f"{_scratch(spark)}/sections"
        reduce(DataFrame.unionByName, parts).write.parquet(place)
    return spark.read.parquet(place)


@query(f"""{ANALYSIS} SELECT 'line/' || metric || '/' || unit AS chart, entity AS series, CASE WHEN o.entity IS NOT NULL THEN 'review_required' ELSE 'ok' END AS status, CASE WHEN o.entity IS NOT NULL THEN 'excluded values are not drawn' END AS note
FROM t LEFT JOIN out_ o USING (entity, metric, unit) UNION ALL
SELECT 'bins/' || metric || '/' || unit, 'count', CASE WHEN n > 0 THEN 'review_required' ELSE 'ok' END, CASE WHEN n > 0 THEN n || ' values are not counted' END
FROM (SELECT metric, unit, count(*) FILTER (reason IS NOT NULL OR lo <> hi) AS n FROM cls LEFT JOIN cell USING (entity, metric, unit, reporting_period) GROUP BY ALL) x WHERE EXISTS (SELECT 1 FROM b WHERE b.metric = x.metric AND b.unit = x.unit)
UNION ALL SELECT 'compare/' || metric || '/' || unit, reporting_period, CASE WHEN n_valued < n_entities THEN 'review_required' ELSE 'ok' END, CASE WHEN n_valued < n_entities THEN 'entities without a verified value are gaps' END FROM comp""")
def chart_status(spark, sf_dir):
    c = _classified(spark, sf_dir)
    return I.chart_status(A.trends(c), A.comparisons(c), A.histogram(c), A.exclusions(c), None).select("chart", "series", "status", "note")


@query(f"""WITH {REC}, {CONF}, s AS (SELECT entity || ' ' || metric || ' ' || reporting_period || ': ' || count(DISTINCT value_raw) || ' different values reported' AS m FROM rec GROUP BY entity, metric, reporting_period, unit HAVING count(DISTINCT value_raw) > 1)
SELECT (SELECT count(*) FROM rec) || ' records, ' || (SELECT count(*) FROM rec WHERE validation_status = 'warning') || ' flagged for review, ' || (SELECT count(*) FROM conf) || ' conflicts. ' ||
       (SELECT string_agg(m, '. ' ORDER BY m) FROM (SELECT m FROM s ORDER BY m LIMIT 5)) AS narrative""")
def narrative(spark, sf_dir):
    rows = IN.records_from_orders(spark, sf_dir)
    cell = _cells(spark, sf_dir)
    found = cell.where("n_values > 1")
    return I.narrative(A.totals(rows, found), I.build(rows, found, A.trends(None, cell), A.comparisons(None, cell)))


@query(f"""WITH {REC} SELECT kpi, count(*) AS n, sum(record_id)::BIGINT AS ids FROM (SELECT record_id, unnest(['records', CASE validation_status WHEN 'pass' THEN 'validated' WHEN 'pending' THEN 'pending' ELSE 'requires_review' END]) AS kpi FROM rec) GROUP BY kpi""")
def kpi_sources(spark, sf_dir):
    return A.count_sources(IN.records_from_orders(spark, sf_dir)).groupBy("kpi").agg(F.count("*").alias("n"), F.sum("record_id").alias("ids"))


@query(f"""{BASE}, agg AS (SELECT metric, unit, reporting_period, sum(CASE WHEN lo = hi THEN lo END) AS total, count(CASE WHEN lo = hi THEN 1 END) AS cells FROM cell GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, unit ORDER BY reporting_period) AS n, dense_rank() OVER (ORDER BY metric, unit) AS g FROM agg WHERE cells > 0)
SELECT metric, unit, reporting_period, round(total::DOUBLE, 4) AS total FROM r WHERE n <= 24 AND g <= 1""")
def capped_kpis(spark, sf_dir):
    return A.aggregates(_classified(spark, sf_dir), max_groups=1, max_periods=24).select("metric", "unit", "reporting_period", _d("total", 4))


@query(f"""{BASE} SELECT entity, metric, unit, count(*) AS n_points FROM cell WHERE lo = hi GROUP BY ALL ORDER BY entity, metric, unit LIMIT 30""")
def capped_trends(spark, sf_dir):
    return A.trends(_classified(spark, sf_dir), top=30).select("entity", "metric", "unit", "n_points")


# --- reviews -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {OUTCOMES} SELECT record_id, document_id, status FROM outcomes WHERE status = 'review_required'""")
def review_queue(spark, sf_dir):
    flagged = _outcomes(spark, sf_dir).withColumn("review_status", F.when(F.col("status") == "review_required", "open").otherwise("resolved"))
    return V.queue(flagged).select("record_id", "document_id", "status")


@query("""SELECT event_id AS record_id, CASE WHEN event_id % 2 = 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 ELSE 0.5 END AS confidence FROM events""")
def review_items(spark, sf_dir):
    rows = IN.records_from_events(spark, sf_dir)
    results = rows.select("record_id", F.lit(0.5).alias("confidence"))
    return V.review_items(results, rows.where("record_id % 2 = 0")).select("record_id", "confidence")


# --- text --------------------------------------------------------------------------------------------------------------


@query(r"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 97 END AS d, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
c AS (SELECT doc_id, d, length(t) > 300 AS truncated, left(t, 300) AS t, row_number() OVER (PARTITION BY d ORDER BY doc_id) AS n FROM f),
u AS (SELECT doc_id, d, truncated, sum(length(t)) OVER (ORDER BY d NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM c WHERE n <= 4)
SELECT doc_id AS unit_id, d AS document_id, truncated FROM u WHERE used <= (SELECT sum(length(t)) // 2 FROM c WHERE n <= 4)""")
def corpus_budget(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    units = docs.select(F.col("doc_id").alias("unit_id"), F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") % 97).alias("document_id"), F.col("text").alias("content"))
    most = T.corpus(units, 4, 300).agg(F.floor(F.sum(F.length("content")) / 2)).first()[0] or 0
    return T.corpus(units, 4, 300, most).select("unit_id", "document_id", "truncated")


@query(f"""WITH {TOK}, {STATS.format('c')}, k AS (SELECT term FROM sc ORDER BY freq DESC, df DESC, term LIMIT 60), o AS (SELECT DISTINCT term, doc_id FROM one WHERE term IN (SELECT term FROM k)),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS n FROM o) SELECT term, string_agg(doc_id || ':page-' || doc_id, ',' ORDER BY doc_id) AS sources FROM r WHERE n <= 8 GROUP BY term""")
def term_sources(spark, sf_dir):
    units = _corpus(spark, sf_dir)
    return T.term_sources(units, T.term_stats(units))


@query(f"""WITH {TOK}, one AS (SELECT doc_id, unnest(c) AS term FROM con), s AS (SELECT doc_id, term, count(*) AS freq FROM one GROUP BY ALL HAVING count(*) >= 2 AND length(term) >= 3),
w AS (SELECT doc_id, term, freq, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, term) AS n FROM s), m AS (SELECT doc_id, term, freq, freq / max(freq) OVER (PARTITION BY doc_id) AS weight, n FROM w WHERE n <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, freq DESC, term) AS k FROM m) SELECT doc_id AS document_id, term, round(weight, 6) AS weight FROM r WHERE k <= 40""")
def clouds_per_document(spark, sf_dir):
    return T.analyze(_corpus(spark, sf_dir), by="document")["cloud"].select("document_id", "term", _d("weight"))
