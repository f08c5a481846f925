"""What must hold so that queries grow no faster than their input: joins that the driver has no part in, work dealt to all cores."""

from labelscan.operators import history, overlays, pixels, resolution
from labelscan.plans import catalogue, labels, stores
from labelscan.sources import adapters
from labelscan.sources.versions import Versions
from labelscan.streaming import dashboard

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_stores_are_joined_without_the_driver(spark, tmp_path):
    """Tables of a few bytes a row look small enough to broadcast at any number of rows."""
    store = Versions(spark, f"file://{tmp_path}/store")
    events = spark.createDataFrame([(1, 1, "PASS", "i", "n", "r"), (2, 2, "REVIEW", "i", "n", "r")], "id long, event_id long, decision string, inspector string, reviewer string, reason string")
    audit = events.selectExpr("id", "event_id", "'' action", "decision", "inspector", "reviewer", "reason")
    resolution.open_store(store, spark.range(9).selectExpr("id", "'REVIEW' overall_result"), audit)
    changes = resolution.changes(events, store.read("reports"), store.read("decisions"), ["event_id"])
    resolution.resolve(store, events, ["event_id"])
    for df in (*changes.values(), store.read("reports"), store.read("decisions"), stores.resolved_reports(spark, FOLDER), stores.audit_events(spark, FOLDER), stores.judged_events(spark, FOLDER)):
        assert "Broadcast" not in plan(df)
    assert {r["id"]: r["overall_result"] for r in store.read("reports").collect()} == {k: "PASS" if k == 1 else "REVIEW" for k in range(9)}


def test_pending_reviews_judge_every_event(spark, tmp_path):
    """An id is pending by events of any number, and resolved by them."""
    events = spark.createDataFrame([(5, 1, 7, "view", "p"), (1, 1, 8, "view", "p"), (6, 2, 8, "purchase", "p"), (2, 1, 9, "purchase", "p")], "event_id long, ts long, user_id long, event_type string, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [r["id"] for r in catalogue.pending_reviews(spark, f"file://{tmp_path}").collect()] == [7]


def test_labels_are_dealt_to_all_cores(spark):
    """A table of one small file is one task to read, but its labels' words aren't one task's work."""
    assert labels.labels(spark, FOLDER).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_pixels_stay_in_their_task(spark):
    """Tiles take their border along: images are cut once, and only sums are shuffled."""
    images = spark.createDataFrame([(k, 3, 40, 1, bytes((k * n) % 251 for n in range(120))) for k in range(5)], "id long, width int, height int, channels int, pixels binary")
    assert plan(pixels.metrics(images, 16)).count("MapIn") == 1
    rows = [sorted(map(tuple, pixels.metrics(images, side).collect())) for side in (1, 16, 512)]
    assert rows[0] == rows[1] == rows[2]


def test_words_are_placed_without_a_shuffle(spark, tmp_path):
    texts = [(1, "ab  é\n\n" + " ".join("x" * (k % 7) for k in range(100)) + "\nend "), (2, ""), (3, None), (4, "\n \n"), *[(k, "a b\nc") for k in range(5, 300)]]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = adapters.words(spark, f"file://{tmp_path}")
    assert "Exchange" not in plan(found) and "Window" not in plan(found)
    want = {(i, n, p, w, 10 + 8 * sum(len(v) + 1 for v in line.split(" ")[:p])) for i, t in texts if t is not None for n, line in enumerate(t.split("\n")) for p, w in enumerate(line.split(" ")) if w}
    assert {tuple(r) for r in found.select("doc_id", "line", "pos", "word", "x").collect()} == want


def test_a_batch_is_read_once(spark, tmp_path):
    """Counts, what they take back and the new rows come from one evaluation of a batch."""
    store, read = Versions(spark, f"file://{tmp_path}/store"), spark.sparkContext.accumulator(0)
    dashboard.open_store(store)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    batch = spark.createDataFrame([(str(k), 1, k > 0, ["mrp"] if k == 0 else []) for k in range(9)], dashboard.CURRENT)
    assert dashboard.fold(store, batch.mapInArrow(seen, batch.schema), 0)
    assert read.value == 9
    assert tuple(dashboard.dashboard(store).first()) == (9, 8, 88.9, [("mrp", 1)])


def test_star_rows_are_dealt_before_they_are_told_apart(spark):
    records = spark.createDataFrame([(k % 50, "p", "2024-01-01", "PASS", {"mrp": False, "date": k % 2 == 0}) for k in range(100)], "id long, product_name string, created_at string, overall_result string, fields map<string, boolean>")
    star = history.fan_out(records)
    assert star["violations"].count() == 75 and star["inspections"].count() == 50
    assert star["violations"].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_free_caption_looks_at_no_other_height(spark):
    rows = [(1, p, "x", 5, 40 * p, 5, 5, 100, 400) for p in range(3)]
    found = overlays.placed(spark.createDataFrame(rows, "image_id int, pos int, text string, left int, top int, width int, height int, image_width int, image_height int"))
    assert "CASE WHEN NOT exists" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3
