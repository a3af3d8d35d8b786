import uuid

from pyspark.sql import functions as F

from factlens.operators import records as R
from factlens.sources import extract as X, lifecycle as L

GRID = [["Mine", "Value", "Unit", "Period"], ["DEMO_MINE_A", "1,200", "tonnes", "2025-06-30"], ["DEMO_MINE_B", "1O5", "tonnes", "2025-06-30"], ["DEMO_MINE_C", " ", None, None]]


def test_grid(spark):
    grids = spark.createDataFrame([(7, "Production", GRID)], "document_id long, sheet_name string, grid array<array<string>>")
    a, b = R.from_grid(grids).orderBy("source_reference").collect()
    assert (a.value_raw, a.normalized_value, float(a.metric_value), a.source_reference, a.extraction_method, a.metric) == ("1,200", "1200", 1200.0, "sheet Production, row 2", "spreadsheet", "demo_production")
    assert (b.value_raw, b.normalized_value, b.metric_value) == ("1O5", None, None)


def test_tables_text_images_and_dispatch(spark):
    tables = spark.createDataFrame([(7, 1, [(1, ["Mine", "Value"], [["DEMO_MINE_A", "500"]])])], "document_id long, section_index int, tables array<struct<table_index:int,headers:array<string>,rows:array<array<string>>>>")
    t = R.from_tables(tables).first()
    assert (t.entity, t.value_raw, t.extraction_method) == ("DEMO_MINE_A", "500", "table") and "table 1" in t.source_reference
    pages = spark.createDataFrame([(1, 7, 1, "page", None, "a\n\nb\n\n\n\nc\n\nd", "extracted"), (2, 7, 2, "image", None, "seen", "ocr_extracted"), (3, 7, 3, "page", None, None, "no_text")], "page_id long, document_id long, page_number int, content_type string, section_reference string, extracted_text string, extraction_status string")
    assert [r.value_raw for r in R.from_text(pages.where("page_id = 1"), 3).collect()] == ["a", "b", "c"]
    out = R.build(pages, 3).collect()
    assert sorted((r.extraction_method, r.value_raw) for r in out) == [("native_text", "a"), ("native_text", "b"), ("native_text", "c"), ("ocr", "seen")]


def test_extraction_isolates_failures(spark):
    files = spark.createDataFrame([(1, "a.TXT", b"hello   world\r\nx"), (2, "b.txt", b"\xff"), (3, "c.bin", b""), (4, "d.txt", b"x")], "document_id long, path string, content binary")

    def text(content):
        yield {"extracted_text": content.decode("utf-8")}

    out = {r.document_id: (r.extraction_status, r.extracted_text, (r.error or "").split(":")[0]) for r in X.run(files, {".txt": text}).collect()}
    assert out == {1: ("extracted", "hello world\nx", ""), 2: ("failed", None, "UnicodeDecodeError"), 3: ("failed", None, "ValueError"), 4: ("ocr_required", "x", "")}
    status = spark.createDataFrame([(1, "extracted"), (1, "no_text"), (2, "no_text")], "document_id long, extraction_status string")
    assert {r.document_id: r.extraction_status for r in X.document_status(status).collect()} == {1: "mixed", 2: "no_text"}


def test_sheets_and_sections(spark):
    s = X.sheet_units(spark.createDataFrame([(1, [["a", None], ["b", "c"]]), (2, [["x"] * 3])], "i int, grid array<array<string>>"), max_cells=2).orderBy("i").collect()
    assert [(r.extraction_status, r.extracted_text) for r in s] == [("failed", None), ("failed", None)]
    s = X.sheet_units(spark.createDataFrame([(1, [["a", None], ["b", "c"]])], "i int, grid array<array<string>>")).first()
    assert (s.extracted_text, s.row_count, s.column_count) == ("a\t\nb\tc", 2, 2)
    blocks = [(1, 1, "paragraph", "Heading 1", "Top", None), (1, 2, "paragraph", None, "p", None), (1, 3, "table", None, None, [["h"], ["v"]]), (1, 4, "paragraph", None, "q", None)]
    out = X.sections(spark.createDataFrame(blocks, "document_id long, ord int, kind string, style string, text string, rows array<array<string>>")).orderBy("section_index").collect()
    assert [(r.extracted_text, r.headers, r.rows) for r in out] == [("[Heading 1] Top\np", None, None), ("", ["h"], [["v"]]), ("q", None, None)]


def test_replacement_is_idempotent(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    rows = lambda v: spark.createDataFrame([(d, f"{d}-{i}", v) for d in range(20) for i in range(3)], "document_id long, k string, v int")
    read = lambda: sorted((r.document_id, r.k, r.v) for r in spark.read.parquet(path).collect())
    L.write_replace(spark, path, rows(1), "a", buckets=4)
    L.write_replace(spark, path, rows(1), "b", buckets=4)
    assert read() == sorted((r.document_id, r.k, r.v) for r in rows(1).collect())
    change = rows(2).where("document_id = 3").limit(2)
    L.write_replace(spark, path, change, "c", buckets=4)
    assert [x for x in read() if x[0] == 3 and x[2] == 2] and len(read()) == 59
    L.write_replace(spark, path, rows(1).limit(0), "d", keys=spark.createDataFrame([(5,)], "document_id long"), buckets=4)
    assert len(read()) == 56
    gone = spark.range(20).selectExpr("id as document_id").where("document_id != 3")
    L.write_replace(spark, path, rows(1).limit(0), "e", keys=gone)  # whole buckets lose all rows
    assert {x[0] for x in read()} == {3}
    L.write_replace(spark, path, rows(1).limit(0), "f", keys=spark.createDataFrame([(3,)], "document_id long"))
    stored = lambda p: sorted((r.document_id, r.k, r.v) for r in L.read_stored(spark, p, rows(1).schema).collect())
    assert stored(path) == []
    L.write_replace(spark, path, rows(3).where("document_id < 2"), "g")
    assert len(stored(path)) == 6


def test_empty_first_write_keeps_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "document_id long, k string")
    L.write_replace(spark, path, one.limit(0), "a", buckets=4)
    assert L.read_stored(spark, path, one.schema).count() == 0
    L.write_replace(spark, path, one, "b", buckets=99)
    assert [(r.document_id, r.k, r.bucket < 4) for r in L.read_stored(spark, path, one.schema).collect()] == [(1, "a", True)]


def test_stream_whose_first_batch_has_no_outcomes(spark, tmp_path):
    from datetime import date

    from factlens.operators import validate as V
    from factlens.streaming import ingest

    schema = "page_id long, document_id long, page_number int, content_type string, section_reference string, extracted_text string, extraction_status string, version int"
    documents = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, filename string")
    config = V.Config(as_of=date(2025, 1, 1), required={}, numeric={"value_raw": V.Numeric()}, ranges={}, dates={})

    def arrive(name, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        ingest.ingest(source, f"{tmp_path}/out", f"{tmp_path}/state", config, documents, buckets=4).awaitTermination()
        return {t: spark.read.parquet(f"{tmp_path}/out/{t}").count() for t in ("records", "outcomes") if list((tmp_path / "out" / t).glob("bucket=*"))}

    assert arrive("one", (1, 1, 1, "page", None, "12", "extracted", 1)) == {"records": 1}
    assert arrive("two", (2, 2, 1, "page", None, "no number\n\n13", "extracted", 1)) == {"records": 3, "outcomes": 1}
    assert arrive("three", (2, 2, 1, "page", None, "", "extracted", 2), (1, 1, 1, "page", None, None, "failed", 2)) == {}


def test_stream_flags_no_record_without_a_key(spark, tmp_path):
    from factlens.streaming import duplicates

    rows = [(1, 1, None, None), (2, 1, "", " "), (3, 1, "a", "x"), (4, 2, "A ", "x"), (5, 2, "a", None)]
    schema = "record_id long, document_id long, entity string, reporting_period string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    flagged = duplicates.flag_duplicates(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    flagged.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [(r.record_id, r.first_record_id) for r in spark.read.schema(flagged.schema).parquet(f"{tmp_path}/out").collect()] == [(4, 3)]


def test_delete_and_missing(spark):
    ids = spark.createDataFrame([(1,)], "document_id long")
    t = spark.createDataFrame([(1, 10), (2, 20)], "document_id long, page_id long")
    assert [r.document_id for r in L.delete({"t": t}, ids)["t"].collect()] == [2]
    assert [(r.document_id, r.page_id) for r in L.forget_pages(t, t.where("page_id = 10").select("page_id")).orderBy("document_id").collect()] == [(1, None), (2, 20)]
    assert L.missing(spark.createDataFrame([(1,), (9,)], "document_id long"), t).first().document_id == 9
    assert L.audit_row(spark, "x", "y", t.agg(F.count("*").alias("n"))).first().details == '{"n":2}'
