"""Intake checks, keys of the star, reports of all ages and the kept-up dashboard, case by case."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscan.operators import intake, legacy, star
from labelscan.sources.versions import Versions
from labelscan.streaming import dashboard

RECORD = "id int, product_id string, session_id string, images array<struct<label:string,source:string,content_type:string>>, labels array<string>, words string, metadata string, confirmations string"
WORD = {"text": "a", "conf": 9, "left": 1, "top": 1, "width": 1, "height": 1}


def record(k, **more):
    own = {"product_id": "p", "session_id": None, "images": [("front", "a.png", "image/png"), (" Back ", "b.png", "image/jpeg")], "labels": None, "words": json.dumps([WORD]), "metadata": None, "confirmations": None} | more
    return (k, *[own[c] for c in ("product_id", "session_id", "images", "labels", "words", "metadata", "confirmations")])


CASES = [
    ({}, []), ({"images": None}, ["no_image"]), ({"images": []}, ["no_image"]), ({"labels": ["front"]}, ["label_count"]), ({"labels": ["front", "back"]}, []),
    ({"images": [("front", "a", "text/html")]}, ["content_type"]), ({"images": [("front", "a", None)]}, ["content_type"]),
    ({"product_id": None}, ["no_identifier"]), ({"product_id": None, "session_id": "s"}, []), ({"product_id": " \t", "session_id": "s"}, ["blank_product_id"]), ({"product_id": "", "session_id": " "}, ["no_identifier", "blank_product_id", "blank_session_id"]),
    ({"images": [("top", "a", "image/png")]}, ["unknown_label"]), ({"images": [(None, "a", "image/png")]}, ["unknown_label"]), ({"images": [("side", " ", "image/png")]}, ["empty_source"]), ({"images": [("side", None, "image/png")]}, ["empty_source"]),
    ({"images": [("side", "a", "image/png"), ("SIDE ", "b", "image/png")]}, ["duplicate_label"]), ({"images": [("side", "a", "image/png"), ("front", "a", "image/png")]}, ["duplicate_source"]),
    ({"words": None}, []), ({"words": "[]"}, []), ({"words": "oops"}, []), ({"words": "[[1, 2, 3]]"}, []), ({"words": json.dumps([WORD, {"text": "b"}])}, ["word_fields"]),
    ({"words": json.dumps([{"text": "b"}]), "metadata": '{"words": []}'}, []), ({"metadata": '{"words": [{"text": "b"}]}'}, ["word_fields"]), ({"metadata": '{"words": null}'}, []), ({"metadata": "{}"}, []),
    ({"confirmations": '{"mrp": true}'}, []), ({"confirmations": "{}"}, []), ({"confirmations": "[1]"}, ["confirmations"]), ({"confirmations": "yes"}, ["confirmations"]), ({"confirmations": "3"}, ["confirmations"]),
]


def test_codes_and_both_sides_of_one_scan(spark, tmp_path):
    df = spark.createDataFrame([record(k, **more) for k, (more, _) in enumerate(CASES)], RECORD).repartition(3)
    assert {r["id"]: r["errors"] for r in intake.checked(df).collect()} == {k: codes for k, (_, codes) in enumerate(CASES)}
    assert [c for c, _ in intake.codes()] == list(intake.CODES)
    read = spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(df.rdd.map(lambda r: (read.add(1), r)[1]), RECORD)
    counts = intake.intake(counted, f"{tmp_path}/out")
    assert read.value == len(CASES)
    bad = Counter(c for _, codes in CASES for c in codes)
    assert counts == {"accepted": sum(not c for _, c in CASES), "quarantined": sum(bool(c) for _, c in CASES)} | {c: bad[c] for c in intake.CODES}
    good, rest = (intake.stored(spark, f"{tmp_path}/out", side) for side in (True, False))
    assert {r["id"] for r in good.collect()} == {k for k, (_, c) in enumerate(CASES) if not c} and rest.count() == counts["quarantined"] and good.drop("errors").columns == df.columns


@pytest.fixture
def tables(spark):
    make = lambda name, *rows: spark.createDataFrame(list(rows), star.STAR[name])
    return {
        "users": make("users", ("u1", "Ann", "admin"), ("u2", "Bo", "viewer")), "products": make("products", ("p1", "i1", "Tea"), ("p2", "i2", None)),
        "inspections": make("inspections", ("a", "p1", "u1", "2026", True), ("b", "p1", None, "2026", False), ("c", "p2", "u1", "2026", False), ("d", None, None, "2026", True)),
        "violations": make("violations", ("b", "mrp", "R"), ("b", "date", "R"), ("c", "mrp", "R")),
    }


def test_deletions_go_down_three_levels_or_are_refused(spark, tables):
    gone, faults = star.deleted("products", spark.createDataFrame([("p1",), ("p1",), ("none",)], "product_id string"), tables)
    left = star.without(tables, gone)
    assert faults.collect() == [] and {n: df.count() for n, df in left.items()} == {"users": 2, "products": 1, "inspections": 2, "violations": 1}
    assert {r["inspection_id"] for r in left["inspections"].collect()} == {"c", "d"} and {n: df.columns for n, df in left.items()} == {n: star.columns(n) for n in tables}
    gone, faults = star.deleted("users", tables["users"], tables)
    assert {(r["tbl"], r["fault"], r["key"]) for r in faults.collect()} == {("inspections", "refers to users", "a"), ("inspections", "refers to users", "c")}


def test_faults_of_changes(spark, tables):
    make = lambda name, *rows: spark.createDataFrame(list(rows), star.STAR[name])
    new = {
        "products": make("products", ("p3", "i3", "New"), ("p1", "i1", "Again"), ("p4", None, None)),
        "inspections": make("inspections", ("e", "p3", "u2", "2026", True), ("f", "p9", "u9", "2026", True), ("e", "p1", None, "2026", None)),
        "violations": make("violations", ("e", "mrp", "R"), ("z", "mrp", "R"), ("b", "mrp", "R")),
    }
    assert {(r["tbl"], r["fault"], r["key"]) for r in star.faults(new, tables).collect()} == {
        ("products", "stored already", "p1"), ("products", "null", "p4"), ("inspections", "no products", "f"), ("inspections", "no users", "f"), ("inspections", "given twice", "e"), ("inspections", "null", "e"),
        ("violations", "no inspections", "z/mrp"), ("violations", "stored already", "b/mrp"),
    }


def test_reports_of_all_ages(spark):
    reports = [
        (1, '{"field_decisions": {"mrp": {"status": "PASS", "extracted_value": "45.00", "confidence": 91.5, "reason": "r", "rule_id": "LM-4"}, "date": {"confidence": "high"}}, "fields": {"mrp": {"present": false}}}'),
        (2, '{"fields": {"mrp": {"present": true, "matched_text": "MRP 45", "description": "Price"}, "date": {"present": "odd"}}}'),
        (3, '{"field_decisions": {}, "fields": {"care": {"present": false, "matched_text": null}}}'), (4, '{"field_decisions": [1], "fields": 3}'), (5, "no json"), (6, None), (7, "{}"),
    ]
    out = legacy.decisions(spark.createDataFrame(reports, "id int, report string"))
    got = {(r["id"], r["field_key"]): tuple(r)[1:2] + tuple(r)[3:] for r in out.collect()}
    assert got == {
        (1, "mrp"): (False, None, "LM-4", "PASS", "45.00", 91.5, "r"), (1, "date"): (False, None, None, "REVIEW", None, None, None),
        (2, "mrp"): (True, "Price", "-", "PASS", "MRP 45", None, "Present in the legacy report."), (2, "date"): (True, "date", "-", "VIOLATION", None, None, "Missing in the legacy report."),
        (3, "care"): (True, "care", "-", "VIOLATION", None, None, "Missing in the legacy report."),
    }
    words = spark.createDataFrame([(2, "mrp", 10, 5, 30, 8), (2, "45", 50, 4, 20, 12), (2, "Tea", 0, 0, 5, 5), (1, "45.00", 0, 0, 1, 1)], "id int, text string, left int, top int, width int, height int")
    boxes = {(r["id"], r["field_key"]): (r["left"], r["top"], r["right"], r["bottom"]) for r in legacy.matched_words(out, words, "id").collect()}
    assert boxes[2, "mrp"] == (10, 4, 70, 16) and {v for k, v in boxes.items() if k != (2, "mrp")} == {(None,) * 4}


def test_dashboard_kept_up_on_a_stream_with_replays_and_a_failure(spark, tmp_path, monkeypatch):
    rnd, store = random.Random(6), Versions(spark, f"file://{tmp_path}/store")
    dashboard.open_store(store)
    (row,) = dashboard.dashboard(store).collect()
    assert tuple(row) == (0, 0, 0.0, [])
    current = {}

    def deliver(n):
        rows = [(f"r{rnd.randrange(25)}", rnd.randrange(1, 9), rnd.random() < 0.4, rnd.choice([None, [], ["mrp"], ["date", "mrp"], ["care", "care"], ["net", "x", "y"]])) for _ in range(30)]
        rows = list({(i, v): r for r in rows for i, v in [r[:2]] if (i, v) not in current}.values())  # a version of a report is written once
        current.update({r[:2]: r for r in rows})
        spark.createDataFrame(rows, dashboard.CURRENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def check():
        newest = {}
        for (i, v), r in sorted(current.items()):
            newest[i] = r
        fields = Counter(f for r in newest.values() for f in set(r[3] or []))
        best = sorted(fields.items(), key=lambda x: (-x[1], x[0]))[:5]
        (row,) = dashboard.dashboard(store).collect()
        good = sum(r[2] for r in newest.values())
        assert (row["total_scanned"], row["compliant_count"]) == (len(newest), good) and row["compliance_rate"] == pytest.approx(100 * good / len(newest), abs=0.051)
        assert [(v["field"], v["count"]) for v in row["most_common_violations"]] == best

    source = lambda: spark.readStream.schema(dashboard.CURRENT).parquet(f"{tmp_path}/in")
    for n in range(2):
        deliver(n)
        dashboard.kept_up(source(), store, f"{tmp_path}/check").awaitTermination()
        check()
    deliver(2)
    publish = Versions._publish

    def lost_after(self, manifest):
        publish(self, manifest)
        raise OSError("lost")

    monkeypatch.setattr(Versions, "_publish", lost_after)  # committed, but the stream doesn't get to know
    with pytest.raises(Exception, match="lost"):
        dashboard.kept_up(source(), store, f"{tmp_path}/check").awaitTermination()
    monkeypatch.undo()
    version = store.manifest()["version"]
    dashboard.kept_up(source(), store, f"{tmp_path}/check").awaitTermination()
    assert store.manifest()["version"] == version  # the batch came again and changed nothing
    check()
    store.compact("counts", "current", "batches")
    check()
