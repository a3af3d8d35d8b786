import pytest
from pyspark.sql import functions as F

from factlens.operators import analytics as A, conflicts as C, insights as I, report
from factlens.plans.analysis import analyze

SCHEMA = "record_id long, document_id long, entity string, metric string, value_raw string, normalized_value string, unit string, reporting_period string, validation_status string"


def records(spark, *rows):
    base = {"document_id": 1, "entity": "Mine A", "metric": "production", "unit": "tonnes", "reporting_period": "2024", "validation_status": "pass", "value_raw": "1000"}
    full = []
    for i, row in enumerate(rows, 1):
        r = base | {"record_id": i} | row
        r.setdefault("normalized_value", r["value_raw"])
        full.append(tuple(r[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(full, SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_counts(spark):
    r = records(spark, {}, {"entity": "Mine B", "validation_status": "warning", "value_raw": "5"}, {"entity": "Mine C", "value_raw": None, "validation_status": "pending"})
    assert one(A.counts(r)).asDict() == {"records": 3, "validated": 1, "requires_review": 1, "pending": 1, "missing": 1, "conflicts": 0}


def test_aggregates(spark):
    r = records(spark, {"value_raw": "100"}, {"entity": "Mine B", "value_raw": "300"}, {"entity": "Mine C", "value_raw": "200"})
    k = one(A.aggregates(A.classify(r)))
    assert [float(k[c]) for c in ("total", "average", "min", "max")] == [600, 200, 100, 300]
    assert {x.kpi: float(x.value) for x in A.kpis(A.classify(r)).collect()} == {"total": 600, "average": 200, "min": 100, "max": 300}


def test_equal_values_count_once_and_keep_sources(spark):
    r = records(spark, {"value_raw": "1200"}, {"document_id": 2, "value_raw": "1200"})
    k = one(A.aggregates(A.classify(r)))
    assert (float(k.total), k.record_ids, k.document_ids) == (1200, [1, 2], [1, 2])


def test_bounded_lists(spark):
    """With bounds the lists are the first ones of those without, and every number stays."""
    rows = [{"entity": f"Mine {i % 5}" if i % 11 else None, "document_id": 90 - i % 7, "value_raw": str(10 * (i % 5)), "reporting_period": str(2020 + i % 3) if i % 13 else None} for i in range(90)]
    rows += [{"entity": "Mine 9", "value_raw": v, "reporting_period": "2020"} for v in ("1", "1", "2", "2", "2")]
    c = A.classify(records(spark, *rows))
    lists = {"record_ids", "document_ids", "points", "sides"}

    def by_key(df, *key):
        return {tuple(r[k] for k in key): r for r in df.collect()}

    whole = [by_key(A.aggregates(c), "metric", "unit", "reporting_period"), by_key(A.trends(c), "entity"), by_key(A.comparisons(c), "reporting_period")]
    cut = [by_key(A.aggregates(c, max_ids=3), "metric", "unit", "reporting_period"), by_key(A.trends(c, max_ids=3), "entity"), by_key(A.comparisons(c, max_ids=3, max_sides=2), "reporting_period")]
    for a, b in zip(whole, cut):
        assert a.keys() == b.keys() and a
        for k in a:
            assert {x: v for x, v in a[k].asDict().items() if x not in lists} == {x: v for x, v in b[k].asDict().items() if x not in lists}
    for k, r in whole[0].items():
        assert cut[0][k].record_ids == r.record_ids[:3] and len(cut[0][k].document_ids) <= 3 and set(cut[0][k].document_ids) <= set(r.document_ids)
    for k, r in whole[1].items():
        assert [(p.value, p.record_ids) for p in cut[1][k].points] == [(p.value, p.record_ids[:3]) for p in r.points]
    for k, r in whole[2].items():
        assert [(s.entity, s.value, s.record_ids) for s in cut[2][k].sides] == [(s.entity, s.value, s.record_ids[:3]) for s in r.sides[:2]]


def test_exclusions(spark):
    r = records(spark, {"entity": "Mine B", "value_raw": "1O5", "normalized_value": None}, {"value_raw": "100"}, {"entity": "C", "validation_status": "error"}, {"entity": "D", "validation_status": "review_required"})
    assert {(x.record_id, x.reason) for x in A.exclusions(A.classify(r)).collect()} == {(1, A.NOT_NUMERIC), (3, A.STATUS), (4, A.STATUS)}
    two = records(spark, {"value_raw": "1200"}, {"value_raw": "1350"})
    assert {x.reason for x in A.exclusions(A.classify(two)).collect()} == {A.CONFLICTING}
    assert A.aggregates(A.classify(two)).count() == 0
    forced = A.classify(records(spark, {"value_raw": "1200"}, {"value_raw": "1300"}), C.conflict_keys(two).limit(0))
    assert A.aggregates(forced).count() == 0 and {x.reason for x in A.exclusions(forced).collect()} == {A.INCONSISTENT}


def test_null_keys_conflict_too(spark):
    r = records(spark, {"unit": None, "value_raw": "1"}, {"unit": None, "value_raw": "2"}, {"value_raw": "3"})
    assert {(x.record_id, x.reason) for x in A.classify(r).collect()} == {(1, A.CONFLICTING), (2, A.CONFLICTING), (3, None)}


@pytest.mark.parametrize(
    ("points", "direction", "change", "percent", "gaps"),
    [
        ([("2024", "100"), ("2025", "120"), ("2026", "150")], "increasing", 50, 50, []),
        ([("2024", "100"), ("2025", "80")], "decreasing", -20, -20, []),
        ([("2024", "100"), ("2025", "100")], "unchanged", 0, 0, []),
        ([("2024-01", "100"), ("2024-03", "120")], "increasing", 20, 20, ["2024-02"]),
        ([("2024", "0"), ("2025", "100")], "increasing", 100, None, []),
    ],
)
def test_trends(spark, points, direction, change, percent, gaps):
    t = one(A.trends(A.classify(records(spark, *[{"reporting_period": p, "value_raw": v} for p, v in points]))))
    assert (t.direction, float(t.absolute_change), t.percent_change if percent is None else float(t.percent_change), t.gaps) == (direction, change, percent, gaps)


def test_trend_leaves_conflicts_out(spark):
    r = records(spark, {"value_raw": "100"}, {"reporting_period": "2025", "value_raw": "120"}, {"reporting_period": "2025", "value_raw": "125"})
    t = one(A.trends(A.classify(r)))
    assert t.review_required and [p.reporting_period for p in t.points] == ["2024"]


def test_comparisons(spark):
    r = records(spark, {"value_raw": "1200"}, {"entity": "Mine B", "value_raw": "1350"}, {"entity": "Mine C", "value_raw": "1400"}, {"entity": "Mine C", "value_raw": "999"})
    c = one(A.comparisons(A.classify(r)))
    assert float(c.difference) == 150 and {s.entity: s.value and float(s.value) for s in c.sides} == {"Mine A": 1200, "Mine B": 1350, "Mine C": None}
    units = records(spark, {"value_raw": "100"}, {"entity": "Mine B", "unit": "kilotonnes", "value_raw": "200"})
    assert A.comparisons(A.classify(units)).count() == 0


def test_histogram(spark):
    h = A.histogram(A.classify(records(spark, {"value_raw": "100"}, {"reporting_period": "2025", "value_raw": "120"}))).orderBy("bin").collect()
    assert [x.n for x in h] == [1, 0, 0, 0, 1]
    assert [x.n for x in A.histogram(A.classify(records(spark, {}, {"entity": "B"}))).collect()] == [2]


def test_insights_and_bundle(spark):
    r = records(spark, {"value_raw": "1200"}, {"value_raw": "1350"}, {"entity": "B", "value_raw": "7", "validation_status": "warning"}, {"entity": "C", "value_raw": None})
    with analyze(r) as tables:
        assert {x.kind for x in tables["insights"].collect()} >= {"CONFLICT", "VALIDATION_WARNING", "DATA_GAP"}
        assert one(tables["narrative"]).narrative.startswith("4 records, 1 flagged")
        assert tables["charts"].count() >= 0
    docs = spark.createDataFrame([(1, "a.pdf")], "document_id long, filename string")
    assert one(report.sections(r, docs)["summary"]).conflicts == 1
    assert {x.value_text for x in report.records(r, docs).collect()} == {"1200 tonnes", "1350 tonnes", "7 tonnes", "DATA MISSING"}


def test_every_record_is_eligible_or_excluded(spark):
    r = records(spark, *[{"entity": e, "value_raw": v, "validation_status": s} for e in "AB" for v in ("1", "x", None) for s in ("pass", "error", None)])
    c = A.classify(r)
    excluded = {x.record_id for x in A.exclusions(c).collect()}
    kept = {i for x in A.cells(c).where("agree").collect() for i in x.record_ids}
    assert excluded.isdisjoint(kept) and excluded | kept == {x.record_id for x in r.collect()}


def test_conflicts_list_all_sides(spark):
    r = records(spark, {"value_raw": "2"}, {"value_raw": "1"}, {"value_raw": "2", "document_id": 3}, {"entity": "B"})
    c = one(C.detect(r))
    assert [(v.value_raw, v.record_ids) for v in c["values"]] == [("2", [1, 3]), ("1", [2])]
    assert {x.document_id: x.conflicts for x in C.per_document(C.detect(r)).collect()} == {1: 1, 3: 1}


def test_plans_have_no_cartesian_product_on_records(spark):
    r = records(spark, {}, {"entity": "B"})
    plan = A.trends(A.classify(r))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Exchange SinglePartition" not in plan


def test_cells_of_one_pass_tell_what_classified_records_do(spark):
    # Conflicts, blanks, texts that are no numbers, NULL keys, statuses, and cells of one raw value with several numbers.
    rows = [
        {"record_id": i, "entity": e, "reporting_period": p, "value_raw": raw, "normalized_value": n, "validation_status": s}
        for i, (e, p, raw, n, s) in enumerate([
            ("A", "2024-01", "1", "1", "pass"), ("A", "2024-03", "3", "3", "pass"), ("A", "2024-03", "3", "3", "valid"), ("A", "2024-04", "4", "4", "pass"), ("A", "2024-04", "5", "5", "pass"),
            ("B", "2024-01", "7", "7", "pass"), ("B", "2024-01", "7", "8", "pass"), ("B", "2024-03", "", "9", "pass"), ("B", "2024-03", None, "9", "pass"), ("B", "2024-04", " ", "2", "warning"),
            (None, "2024-01", "6", "6", "pass"), ("C", None, "2", "2", "pass"), ("C", None, "2", "x", "pass"), ("D", "2024-03", "3", "3", None), ("D", "2024-04", "x", "x", "pass"), ("D", "2024-01", "1", "1.0", "pass"),
        ])
    ]
    r = records(spark, *rows).localCheckpoint()
    c, cell = A.classify(r), A.cell_states(r).localCheckpoint()
    same = lambda a, b, *columns: assert_same(a.select(*columns), b.select(*columns))
    same(A.trends(None, cell), A.trends(c), "entity", "metric", "unit", "first_period", "last_period", "first_value", "last_value", "n_points", "absolute_change", "percent_change", "direction", "gaps")
    same(A.comparisons(None, cell), A.comparisons(c), "metric", "unit", "reporting_period", "n_entities", "n_valued", "difference")
    same(cell.where("n_values > 1"), C.detect(r), "entity", "metric", "reporting_period", "unit", "n_values")
    bins = A.histogram(A.eligible_rows(r, cell))
    same(bins, A.histogram(c), "metric", "unit", "bin", "low", "high", "n")
    same(I.chart_points(A.trends(None, cell), A.comparisons(None, cell), bins, cell), I.chart_points(A.trends(c), A.comparisons(c), A.histogram(c)), "chart", "series", "x", "y")
    # One stored table is read, where least texts were sorted in a pass for each part.
    assert "SortAggregate" not in A.cell_states(r)._jdf.queryExecution().executedPlan().toString()


def assert_same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_written_json_is_small_and_reads_as_it_was(spark, tmp_path):
    rows = [(i, i % 3, f"cust-{i % 5}", "order_total", "USD", "2024-01", str(i % 2), "pass") for i in range(5000)]
    records = spark.createDataFrame(rows, "record_id long, document_id long, entity string, metric string, unit string, reporting_period string, value_raw string, validation_status string").withColumn("normalized_value", F.col("value_raw"))
    documents = spark.createDataFrame([(i, f"f{i}") for i in range(3)], "document_id long, filename string")
    tables = report.sections(records, documents)
    path = tmp_path / "report"
    report.write_json(tables, str(path))
    wanted = {(r.section, r.payload) for r in report.to_json_rows(tables).collect()}
    assert {(r.section, r.value) for r in spark.read.text(str(path)).collect()} == wanted
    assert 8 * sum(f.stat().st_size for f in path.rglob("part-*")) < sum(len(p) for _, p in wanted)
    assert tables["summary"].first().conflicts == 5
