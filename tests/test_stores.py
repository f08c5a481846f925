"""Commits of several tables, resolution of reviews, and both review machines on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from labelscan.operators import resolution, review
from labelscan.sources.versions import Conflict, Versions
from labelscan.streaming import reviews

EVENTS = "id string, n int, decision string, inspector string, reviewer string, reason string"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@pytest.fixture
def store(spark, tmp_path):
    reports = spark.createDataFrame([("r1", "REVIEW", {"mrp": ("REVIEW", "low"), "date": ("PASS", "")}), ("r2", "REVIEW", None), ("r3", "PASS", None)], "id string, overall_result string, field_decisions map<string, struct<status: string, reason: string>>")
    out = Versions(spark, f"file://{tmp_path}/store")
    resolution.open_store(out, reports, spark.createDataFrame([], "id string, n int, action string, decision string, inspector string, reviewer string, reason string"))
    return out


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def events(spark, *data):
    return spark.createDataFrame(list(data), EVENTS)


def state(store):
    return rows(store.read("reports"), "id", "overall_result", "reviewer_status"), rows(store.read("decisions"), "id", "review_status", "final_decision", "inspector"), store.read("audit").count()


def test_retains_then_resolves_with_audit_trail_and_another_reader(spark, store):
    (first,) = resolution.decision_of(store, "r1").collect()
    assert first["automated_reasons"] == {"mrp": "low"} and first["review_status"] == "PENDING" and first["trail"] == []
    assert resolution.resolve(store, events(spark, ("r1", 1, "review", "i-1", "Ann", None)), ["n"]) == 2
    assert state(store)[0] == {("r1", "REVIEW", "PENDING"), ("r2", "REVIEW", None), ("r3", "PASS", None)}
    resolution.resolve(store, events(spark, ("r1", 2, " pass ", "i-2", "Bo", "label seen")), ["n"])
    again = Versions(spark, store.root)  # as after a restart
    assert state(again) == ({("r1", "PASS", "RESOLVED"), ("r2", "REVIEW", None), ("r3", "PASS", None)}, {("r1", "RESOLVED", "PASS", "i-2"), ("r2", "PENDING", "REVIEW", None)}, 2)
    (row,) = resolution.decision_of(again, "r1").collect()
    assert [(e["action"], e["decision"], e["inspector"], e["reviewer"], e["reason"]) for e in row["trail"]] == [("retain_review", "REVIEW", "i-1", "Ann", ""), ("resolve", "PASS", "i-2", "Bo", "label seen")]
    resolution.resolve(again, events(spark, ("r1", 3, "VIOLATION", "i-3", "Cy", "late")), ["n"])
    assert state(again)[1] == {("r1", "RESOLVED", "PASS", "i-2"), ("r2", "PENDING", "REVIEW", None)}
    assert resolution.decision_of(again, "r3").collect() == []


def test_first_check_that_fails(spark, store):
    data = [("r1", 1, "maybe", "", "", ""), ("r1", 2, "PASS", " ", "Ann", "x"), ("r1", 3, "PASS", "i", None, "x"), ("r1", 4, "PASS", "i", "Ann", " "), ("r9", 5, "PASS", "i", "Ann", "x"), ("r3", 6, "PASS", "i", "Ann", "x"), (None, 7, "PASS", "i", "Ann", "x"), ("r1", 8, "PASS", "i", "Ann", "x"), ("r1", 9, "REVIEW", "i", "Ann", "x")]
    got = {n: o for n, o in rows(resolution.judged(events(spark, *data), store.read("decisions"), ["n"]), "n", "outcome")}
    assert got == {1: "invalid decision", 2: "missing identity", 3: "missing identity", 4: "missing reason", 5: "review not found", 6: "review not found", 7: "review not found", 8: "accepted", 9: "already resolved"}


def test_a_failure_between_the_two_writes_shows_the_old_state_of_both(spark, store, monkeypatch):
    old, write = state(store), Versions._write

    def broken(self, df, name, version):
        if name == "decisions":
            raise OSError("lost")
        return write(self, df, name, version)

    monkeypatch.setattr(Versions, "_write", broken)
    with pytest.raises(OSError):
        resolution.resolve(store, events(spark, ("r1", 1, "PASS", "i", "Ann", "x")), ["n"])
    assert state(store) == old
    monkeypatch.undo()
    # a failure inside the second write, and one before the manifest is renamed
    bad = store.read("decisions").withColumn("final_decision", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit(store.manifest(), reports=store.read("reports").withColumn("overall_result", F.lit("PASS")), decisions=bad)
    monkeypatch.setattr(Versions, "_publish", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        resolution.resolve(store, events(spark, ("r1", 1, "PASS", "i", "Ann", "x")), ["n"])
    assert state(store) == old
    monkeypatch.undo()
    assert store.vacuum() >= 3 and state(store) == old
    resolution.resolve(store, events(spark, ("r1", 1, "PASS", "i", "Ann", "x")), ["n"])
    assert ("r1", "PASS", "RESOLVED") in state(store)[0]


def test_the_second_of_two_commits_from_one_version_starts_anew(spark, store):
    manifest = store.manifest()
    store.commit(manifest, reports=store.read("reports").filter("id = 'r1'").withColumn("overall_result", F.lit("PASS")))
    with pytest.raises(Conflict):
        store.commit(manifest, reports=store.read("reports").filter("id = 'r2'").withColumn("overall_result", F.lit("PASS")))
    assert rows(store.read("reports"), "id", "overall_result") == {("r1", "PASS"), ("r2", "REVIEW"), ("r3", "PASS")}
    # a reader that has resolved its manifest goes on to see that version
    assert rows(store.read("reports", manifest), "id", "overall_result") == {("r1", "REVIEW"), ("r2", "REVIEW"), ("r3", "PASS")}


def test_compaction_and_new_rows(spark, store):
    for k in range(3):
        resolution.resolve(store, events(spark, ("r1", k, "REVIEW", f"i{k}", "Ann", None)), ["n"])
    store.commit(store.manifest(), reports=store.read("reports").limit(1).withColumns({"id": F.lit("new"), "overall_result": F.lit("PASS")}))
    before = state(store)
    store.compact("reports", "decisions", "audit")
    assert state(store) == before and all(len(t["parts"]) == 1 for t in store.manifest()["tables"].values())
    assert ("new", "PASS", "PENDING") in before[0] or ("new", "PASS", None) in before[0]


def random_events(n):
    rnd = random.Random(n)
    pick = lambda *xs: rnd.choice(xs)
    durable = [(rnd.randrange(50), k, pick("PASS", "REVIEW", "REVIEW", "VIOLATION", "odd"), pick("i", "i", " ", None), pick("r", "r", "", None)) for k in range(0, 3 * n, 3)]
    session = [(rnd.randrange(50), k, pick("create", "confirm", "override"), pick(" review", "REVIEW", "PASS", None), pick("i", "i", None), pick("r", " ")) for k in range(1, 3 * n, 2)]
    return durable, session


def test_close_out_in_one_batch_and_on_a_stream(spark, tmp_path):
    durable, session = random_events(120)
    d = spark.createDataFrame(durable, "id long, event_id long, decision string, inspector string, reason string")
    s = spark.createDataFrame(session, "id long, event_id long, action string, system_status string, inspector string, reason string")
    shown = ("id", "event_id", "machine", "action", "outcome", "state")
    want = rows(review.close_out(d, s, "event_id"), *shown)
    assert {m for _, _, m, *_ in want} == {"durable", "session", "closing"}
    both = reviews.events_of(d, s)
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    for run in range(3):  # three deliveries in order, each by a query that goes on from the checkpoint
        both.filter((F.col("event_id") >= 120 * run) & (F.col("event_id") < 120 * (run + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = reviews.reviews(spark.readStream.schema(both.schema).parquet(f"{tmp_path}/events"))
        q = stream.writeStream.outputMode("append").format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").start()
        q.awaitTermination()
    for k in ROCKS:
        spark.conf.unset(k)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got, *shown) == want and got.count() == len(want)


def test_resolving_confirms_the_session_review_whatever_the_outcome(spark):
    d = spark.createDataFrame([(1, 5, "VIOLATION", "i", "bad"), (2, 5, "PASS", "i", "ok"), (3, 5, "REVIEW", "i", None)], "id long, event_id long, decision string, inspector string, reason string")
    s = spark.createDataFrame([(1, 1, "create", "REVIEW", None, None), (1, 9, "override", None, "i", "r"), (3, 1, "create", "REVIEW", None, None)], "id long, event_id long, action string, system_status string, inspector string, reason string")
    got = rows(review.close_out(d, s, "event_id").filter("machine <> 'durable'"), "id", "event_id", "machine", "outcome", "state")
    assert got == {(1, 1, "session", "accepted", "PENDING"), (1, 5, "closing", "accepted", "CONFIRMED"), (1, 9, "session", "already completed", "CONFIRMED"), (3, 1, "session", "accepted", "PENDING")}
