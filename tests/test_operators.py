"""Golden cases of history, review, decision and geometry operators."""

import pytest
from pyspark.sql import functions as F

from labelscan.functions import geometry, text
from labelscan.operators import decisions, extract, history, review, words
from labelscan.sources import dims, readers
from labelscan.streaming import trend

REPORTS = "id string, filename string, product_name string, created_at string, overall_result string"


def reports(spark, *rows):
    return spark.createDataFrame(list(rows), REPORTS)


def test_pages_and_search(spark):
    df = reports(spark, ("identifier-tea", "a.png", "Masala Tea", "2026-09-19T09:00:00", "PASS"), ("identifier-coffee", "b.png", None, "2026-09-19T10:00:00", "REVIEW"))
    ids = lambda x: [r["id"] for r in x.collect()]
    assert ids(history.page(df)) == ["identifier-coffee", "identifier-tea"]
    assert ids(history.page(df, query="TEA")) == ["identifier-tea"] and len(ids(history.page(df, query="identifier"))) == 2
    assert ids(history.page(df, limit=1, offset=1)) == ["identifier-tea"] and ids(history.page(df, status="review")) == ["identifier-coffee"]


def test_literal_search(spark):
    df = reports(spark, ("a1", "tea.png", None, "", "PASS"), ("a2", "100%_pure.png", None, "", "PASS"), ("a3", "back\\slash.png", None, "", "PASS"))
    found = lambda q: {r["id"] for r in df.filter(history.predicates(query=q)).collect()}
    assert [found(q) for q in ("%", "_", "100%_", "a_", "\\", "TEA")] == [{"a2"}, {"a2"}, {"a2"}, set(), {"a3"}, {"a1"}]


def test_ranges_rates_trend(spark):
    df = reports(spark, *[(str(k), "f", None, f"2026-09-{t}+00:00", s) for k, (t, s) in enumerate([("18T23:00:00", "PASS"), ("19T12:00:00", "REVIEW"), ("19T13:00:00", "VIOLATION"), ("20T01:00:00", "odd")])])
    assert history.count(df, start="2026-09-19", end="2026-09-19").first()["total"] == 2
    row = history.rates(df, start="2026-09-19").first()
    assert (row["total"], row["n_pass"], row["review_rate"], row["violation_rate"]) == (2, 0, 0.5, 0.5)
    days = [(r["date"], r["total"]) for r in history.daily_trend(df, 3).collect()]
    assert days == [("2026-09-20", 0), ("2026-09-19", 2), ("2026-09-18", 1)]
    assert history.rates(df.limit(0)).first()["review_rate"] == 0.0 and history.daily_trend(df.limit(0)).count() == 0
    for bad in (dict(limit=0), dict(limit=101), dict(offset=-1), dict(limit=True), dict(status="maybe"), dict(start="2026-09-20", end="2026-09-19"), dict(start="yesterday")):
        with pytest.raises(ValueError):
            history.page(df, **bad)
    with pytest.raises(ValueError):
        history.daily_trend(df, 91)


def test_product_names(spark):
    df = spark.createDataFrame([("x", "y", "z"), (None, "  Masala   Tea \n Premium ", "z"), (None, " ", "q" * 5000), (None, None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(history.product_name(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["x", "Masala Tea Premium", "q" * 200, None]


def test_durable_review(spark):
    events = [(1, 1, "REVIEW", "i", None), (1, 2, "PASS", "i", "ok"), (1, 3, "PASS", "i", "ok"), (2, 1, "PASS", None, "r"), (2, 2, "PASS", "i", " "), (2, 3, "MAYBE", "i", "r"), (2, 4, "VIOLATION", "i", "r")]
    df = spark.createDataFrame(events, "id long, seq int, decision string, inspector string, reason string")
    folded = review.durable(df, "seq")
    assert [r["outcome"] for r in folded.orderBy("id", "seq").collect()] == ["accepted", "accepted", "not pending", "missing identity", "missing reason", "invalid decision", "accepted"]
    got = {r["id"]: (r["state"], r["final_decision"], r["n_audit"], r["n_rejected"]) for r in review.resolutions(folded, "seq").collect()}
    assert got == {1: ("RESOLVED", "PASS", 2, 1), 2: ("RESOLVED", "VIOLATION", 1, 3)}
    assert [e["action"] for e in review.audit_trail(folded, "seq").filter("id = 1").first()["trail"]] == ["retain_review", "resolve"]


def test_session_review(spark):
    events = [
        (1, 1, "create", "REVIEW", None, None), (1, 2, "confirm", None, "i", None), (1, 3, "confirm", None, "i", None), (1, 4, "override", None, "i", "r"), (1, 5, "create", "REVIEW", None, None),
        (2, 1, "create", "PASS", None, None), (2, 2, "confirm", None, "i", None), (3, 1, "create", " review ", None, None), (3, 2, "override", None, None, None), (3, 3, "override", None, None, "r"), (3, 4, "override", None, "i", "r"), (3, 5, "confirm", None, "i", None),
    ]
    df = spark.createDataFrame(events, "id long, seq int, action string, system_status string, inspector string, reason string")
    got = [(r["outcome"], r["state"]) for r in review.session(df, "seq").orderBy("id", "seq").collect()]
    assert [g[0] for g in got] == ["accepted", "accepted", "unchanged", "already completed", "duplicate", "not created", "unknown review", "accepted", "missing reason", "missing identity", "accepted", "already completed"]
    assert got[3][1] == "CONFIRMED" and got[-1][1] == "OVERRIDDEN"


def test_evidence_and_decisions(spark):
    rows = [(1, 0, "FOUND", 80.0, 2, "front", "a"), (1, 0, "FOUND", 96.0, 1, "back", "b"), (1, 1, "FOUND", 90.0, 1, "side", "c"), (1, 1, "FOUND", 90.0, 1, "front", "a"), (1, 2, "NOT_FOUND", 0.0, 0, "front", "a")]
    df = spark.createDataFrame(rows, "product_id long, field_no int, status string, conf double, context_score int, label string, source string")
    best = decisions.best_evidence(df, ["product_id", "field_no"])
    assert {r["field_no"]: r["label"] for r in best.collect()} == {0: "back", 1: "front", 2: "front"}
    assert decisions.coverage(df).first()["coverage_status"] == "complete"
    judged = decisions.decide(best.withColumns({"reason": F.lit("x"), "complete": F.lit(True), "sufficient": F.lit(True)}))
    assert decisions.overall(judged, "product_id").first()["overall_result"] == "VIOLATION"
    judged = decisions.decide(best.withColumns({"reason": F.lit("x"), "complete": F.lit(False), "sufficient": F.lit(True)}))
    assert decisions.overall(judged, "product_id").first()["overall_result"] == "REVIEW"


def test_score(spark):
    fields = spark.createDataFrame([(1, "critical", True), (2, "critical", True)], "id long, severity string, present boolean")
    extras = spark.createDataFrame([(1, "PASS", 0, 0), (2, "REVIEW", 0, 0), (3, "PASS", 9, 9)], "id long, overall_result string, n_flags int, n_notes int")
    got = {r["id"]: (r["score"], r["grade"], r["pending_review"]) for r in decisions.score(fields, extras).collect()}
    assert got == {1: (80, "B", False), 2: (None, None, True), 3: (0, "F", False)}


def test_quality_checks(spark):
    images = spark.createDataFrame([(1, 20, 20, bytearray(b"\x80" * 400)), (2, 20, 20, bytearray(b"\xff\x00" * 200))], "id long, width int, height int, pixels binary")
    m = {r["id"]: r for r in decisions.pixel_metrics(images).collect()}
    assert (m[1]["blur"], m[1]["brightness"], m[1]["contrast"]) == (0.0, 128.0, 0.0) and m[2]["glare"] == 0.5
    good = spark.createDataFrame([(1200, 1000, 400.0, 130.0, 0.0, 60.0), (1200, 1000, 10.0, 130.0, 0.0, 60.0), (600, 700, 400.0, 130.0, 0.0, 60.0)], "width int, height int, blur double, brightness double, glare double, contrast double")
    got = [(r["status"], r["recommendation"], r["allows_ocr"]) for r in decisions.quality_checks(good).collect()]
    assert got == [("GOOD", "PROCEED", True), ("POOR", "REVIEW", False), ("WARNING", "REVIEW", True)]


def test_geometry(spark):
    one = spark.range(1)
    box = {k: F.lit(v) for k, v in dict(left=95, top=96, width=20, height=20).items()}
    got = one.select(*[v.alias(k) for k, v in geometry.clamp(box, F.lit(100), F.lit(100)).items()]).first()
    assert tuple(got) == (95, 96, 5, 4)
    assert one.select(geometry.to_source(F.lit(20), 2.0, F.lit(300))).first()[0] == 310
    tiles = one.select(geometry.tiles(F.lit(100), F.lit(300)).alias("t")).first()["t"]
    assert [tuple(t) for t in tiles] == [(0, 0, 100, 118), (0, 82, 100, 136), (0, 182, 100, 118)]


def test_text(spark):
    df = spark.createDataFrame([("31/02/24",), ("29/02/2024",), ("13/2024",), ("04/24",), ("04/225",)], "x string")
    assert [r[0] for r in df.select(extract.real_date(F.col("x"))).collect()] == [False, True, False, True, False]
    df = spark.createDataFrame([("250g",), ("Weight",)], "x string")
    assert [r[0] for r in df.select(text.text_detail(F.col("x"))).collect()] == [5, 6]


def test_manifest_and_log(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"products": [{"id": "p", "images": [{"path": "a.png", "label": "front", "visible_text": ["x"]}], "expected": {"mrp": "45.00"}}]}')
    images, expected = readers.manifest(spark, f"file://{tmp_path}/m.json")
    assert images.first()["label"] == "front" and tuple(expected.first()) == ("p", "mrp", "45.00")
    df = reports(spark, ("1", "f", None, "2026-09-18T23:00:00", "PASS"))
    readers.append_log(df, f"{tmp_path}/log")
    readers.append_log(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    stars = history.fan_out(df.withColumn("fields", F.create_map(F.lit("mrp"), F.lit(False), F.lit("x"), F.lit(True))))
    assert [stars[k].count() for k in ("products", "inspections", "violations")] == [1, 1, 1]
    assert dims.vocabulary(spark).count() == 46


def test_streams(spark, tmp_path):
    rows = [(k, f"2026-09-{18 + k // 2} 0{k}:00:00", "PASS" if k % 2 else "REVIEW") for k in range(6)]
    spark.createDataFrame(rows, "id long, ts string, overall_result string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, ts timestamp, overall_result string").parquet(f"{tmp_path}/in")
    q = trend.daily(stream).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination()
    assert {(r["date"], r["n_pass"], r["total"]) for r in spark.table("days").collect()} == {(f"2026-09-{d}", 1, 2) for d in (18, 19, 20)}


def test_overlapping_boxes_of_any_size_and_line(spark):
    """Against all pairs: wide boxes that hold small ones far to their right, tall ones, other lines, other documents."""
    import random

    rnd = random.Random(4)
    schema = "doc_id int, line int, pos int, word string, x int, top int, width int, height int"
    boxes = [(1, 0, 0, "wide", 0, 0, 1760, 12), (1, 3, 1, "inside", 1590, 2, 160, 8)]
    boxes += [(k % 3, rnd.randrange(5), k + 2, "w", rnd.randrange(-300, 2000), rnd.randrange(-50, 900), rnd.choice([0, 1, 30, 300, 2500]), rnd.choice([1, 12, 700])) for k in range(150)]
    df = spark.createDataFrame(boxes, schema)
    want = set()
    for a in boxes:
        for b in boxes:
            wide, tall = min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]), min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])
            area = min(a[6] * a[7], b[6] * b[7])
            if a[0] == b[0] and area and max(0, wide) * max(0, tall) / area >= 0.2:
                want.add((a[0], a[2], b[2]))
    got = words.overlapping(df, df).collect()
    assert {(r["doc_id"], r["pos"], r["b_pos"]) for r in got} == want and len(got) == len(want) and (1, 0, 1) in want
