"""Commits over several tables: what a stopped job leaves, versions in any order, buckets."""

import itertools
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from factlens.operators import validate as V
from factlens.sources import lifecycle as L, store as S
from factlens.streaming import ingest as G

SCHEMAS = {"a": "document_id long, v int", "b": "document_id long, v int, k string", "c": "document_id long, n long"}


def tables(spark, ids, v):
    a = spark.createDataFrame([(d, v) for d in ids], SCHEMAS["a"])
    return {"a": a, "b": a.withColumn("k", F.explode(F.array(F.lit("x"), F.lit("y")))), "c": a.select("document_id", F.lit(v).cast("long").alias("n"))}


def seen(store, state=None):
    state = state or store.state()
    return {name: sorted(map(tuple, store.read(name, state).collect())) for name in SCHEMAS}


def as_rows(parts):
    return {name: sorted(tuple(r) for df in parts for r in df[name].collect()) for name in SCHEMAS}


def test_a_job_stopped_between_any_two_writes_shows_the_old_state(spark, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path / "s"), SCHEMAS, buckets=4)
    old = tables(spark, range(12), 1)
    assert store.commit(old, "first")
    before, new = as_rows([old]), tables(spark, [1, 2, 50], 2)
    kept = {name: df.where("document_id not in (1, 2, 50)") for name, df in old.items()}
    after, real = as_rows([kept, new]), S._write
    for stop in itertools.count():
        calls = []

        def failing(df, path, by=()):
            if len(calls) == stop:
                raise OSError("stopped")
            calls.append(path)
            real(df, path, by)

        monkeypatch.setattr(S, "_write", failing)
        assert seen(store) == before
        try:
            done = store.commit(new, "second")
        except OSError:
            assert seen(store) == before
            continue
        break
    assert done and stop == len(SCHEMAS) + 1 and seen(store) == after
    monkeypatch.setattr(S, "_write", real)
    assert not store.commit(tables(spark, [1], 9), "second") and seen(store) == after
    assert seen(store, store.state(1)) == before
    assert store.vacuum(2) > 0 and seen(store) == after and seen(store, store.state(1)) == before
    store.vacuum(1)
    assert seen(store) == after and store.vacuum(1) == 0


def test_keys_deletion_rebucketing_and_foreign_rows(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"), SCHEMAS, buckets=4)
    assert seen(store) == {name: [] for name in SCHEMAS}
    store.commit(tables(spark, range(10), 1), "1")
    store.commit({"a": tables(spark, [3, 4], 2)["a"]}, "2", spark.createDataFrame([(3,)], "document_id int"))  # 4 is no key, b and c lose 3
    got = seen(store)
    assert (3, 2) in got["a"] and (4, 1) in got["a"] and {d for d, *_ in got["b"]} == {d for d, _ in got["c"]} == set(range(10)) - {3}
    store.rebucket(7, "3")
    assert seen(store) == got and store.state().buckets == 7
    store.commit({}, "4", spark.range(10).selectExpr("id as document_id"))
    assert seen(store) == {name: [] for name in SCHEMAS}
    store.commit({}, "5", spark.range(0).selectExpr("id as document_id"))
    assert store.state().number == 5
    with pytest.raises(ValueError):
        store.commit({"z": tables(spark, [1], 1)["a"]}, "6")


def test_one_table_is_refused_without_its_number_of_buckets(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    rows = spark.range(200).selectExpr("id as document_id", "1 as v")
    L.write_replace(spark, path, rows, "a", buckets=8)
    L._delete(spark, f"{path}.buckets")
    with pytest.raises(ValueError):
        L.write_replace(spark, path, rows.limit(10), "b")
    assert spark.read.parquet(path).count() == 200


def page(version, page_id, text, document_id=1):
    return (page_id, document_id, page_id, "page", None, text, "extracted", version)


PAGES = "page_id long, document_id long, page_number int, content_type string, section_reference string, extracted_text string, extraction_status string, version long"


def test_batches_in_any_order_end_in_one_state(spark, tmp_path):
    batches = [[page(1, 1, "old"), page(1, 2, "old too"), page(7, 9, "other", 2)], [page(3, 1, "new one")], [page(3, 2, "new two"), page(None, 5, "none", 3)], [page(2, 1, "middle"), page(3, 1, "new one")]]
    config, documents = V.Config(as_of=date(2025, 1, 1)), spark.createDataFrame([(1, "f.pdf")], "document_id long, filename string")
    found = []
    for number, order in enumerate(([0, 1, 2, 3], [3, 2, 0, 1])):
        root = str(tmp_path / str(number))
        for at, i in enumerate(order):
            spark.createDataFrame(batches[i], PAGES).coalesce(1).write.parquet(f"{root}/in/{at}")
            source = spark.readStream.schema(PAGES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{root}/in")
            G.ingest(source, f"{root}/store", f"{root}/state", config, documents, buckets=2).awaitTermination()
        store = G.tables(spark, f"{root}/store", source, config, documents, buckets=2)
        state = store.state()
        assert state.number == 4
        texts = sorted((r["document_id"], r["version"], r["extracted_text"]) for r in store.read("pages", state).collect() if r["version"])
        assert texts == [(1, 3, "new one"), (1, 3, "new two"), (2, 7, "other")]
        found.append({name: sorted(map(str, store.read(name, state).collect())) for name in store.schemas})
    assert found[0] == found[1]
    assert any("new two" in r for r in found[0]["records"]) and not any("old" in r for rows in found[0].values() for r in rows)


RECORDS = "record_id long, document_id long, entity string, reporting_period string"


def flagged(spark, root, batches, name="state", **how):
    """What the stream under root emits for each of these batches of records, arriving one after the other."""
    from factlens.streaming import duplicates

    out = []
    for rows in batches:
        spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = duplicates.flag_duplicates(spark.readStream.schema(RECORDS).parquet(f"{root}/in"), **how)
        stream.writeStream.format("parquet").option("path", f"{root}/{name}-out").option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start().awaitTermination()
        now = {(r["record_id"], r["first_record_id"]) for r in spark.read.schema(stream.schema).parquet(f"{root}/{name}-out").collect()}
        out.append(now)
    return out


def test_flags_know_stored_records_after_a_new_checkpoint(spark, tmp_path):
    stored = spark.createDataFrame([(1, 1, "A", "2024"), (5, 1, " a", "2024"), (2, 1, "b", "2024"), (9, 1, None, None)], RECORDS)
    batches = [[(20, 2, "a ", "2024"), (21, 2, "c", "2024"), (1, 1, "A", "2024"), (22, 2, None, None)], [(30, 3, "C", "2024"), (31, 3, "b", "2024")]]
    first, second = flagged(spark, str(tmp_path), batches, known=stored)
    assert first == {(20, 1)} and second == {(20, 1), (30, 21), (31, 2)}
    # Without the stored records a new checkpoint would take what arrives first for the first.
    assert flagged(spark, str(tmp_path / "x"), batches[:1]) == [{(20, 1)}]
    assert flagged(spark, str(tmp_path / "y"), batches[1:], known=stored) == [{(31, 2)}]


@pytest.mark.parametrize("ttl, want", [("600000", {(2, 1)}), ("500", set())])
def test_keys_are_forgotten_after_their_time(spark, tmp_path, ttl, want):
    import time

    from factlens.streaming import duplicates

    root = str(tmp_path)
    write = lambda rows: spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    write([(1, 1, "a", "2024")])
    stream = duplicates.flag_duplicates(spark.readStream.schema(RECORDS).parquet(f"{root}/in"), ttl=ttl)
    job = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(processingTime="1 second").start()

    def consumed(n):
        for _ in range(120):
            if sum(p["numInputRows"] for p in job.recentProgress) >= n:
                return True
            time.sleep(0.5)
        return False

    try:
        assert consumed(1)
        time.sleep(3)
        write([(2, 1, "a", "2024")])
        assert consumed(2)
    finally:
        job.stop()
    assert {(r["record_id"], r["first_record_id"]) for r in spark.read.schema(stream.schema).parquet(f"{root}/out").collect()} == want


def test_pages_move_once_on_their_way_to_the_store(spark, tmp_path):
    schema = "page_id long, document_id long, extracted_text string, version int"
    stored = spark.createDataFrame([(1, 1, "old", 1), (2, 1, "old too", 1), (3, 2, "stays", 3), (4, 3, "none", None)], schema)
    batch = spark.createDataFrame([(1, 1, "new", 2), (3, 2, "late", 2), (5, 2, "joins", 3), (4, 3, "first", 0), (6, 4, "x", None), (7, None, "nobody's", 9)], schema)
    files = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "document_id long, filename string")
    store = S.Store(spark, str(tmp_path / "s"), {"pages": schema}, 4)
    out = G.merged(stored, batch, "version", files, lambda rows: store.dealt(rows, 4))
    got = {(r.document_id, r.page_id, r.extracted_text, r.version, r.filename) for r in out.collect()}
    assert got == {(1, 1, "new", 2, "a"), (2, 3, "stays", 3, "b"), (2, 5, "joins", 3, "b"), (3, 4, "first", 0, None), (4, 6, "x", None, None)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count(" Exchange ") == 1 and "Join" not in plan
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "document_id long")
    for number in range(2):  # into empty buckets, and over what they hold
        assert store.commit({"pages": out}, str(number), keys, placed=True)
        assert {(r.document_id, r.page_id, r.extracted_text, r.version) for r in store.read("pages").collect()} == {g[:4] for g in got}
    assert store.read("pages").count() == 5
