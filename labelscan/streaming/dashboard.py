"""The dashboard row, kept up as reports arrive and change.

Each micro-batch is folded into keyed counts: a report's new version takes back what its old one had counted (signed
deltas), so nothing is counted again from the start.  Current reports, counts and the number of the batch change in one commit, so a
batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions

KEYS = {"current": ["id"], "counts": ["measure", "field_key"], "batches": ["stream"]}
CURRENT = "id string, version long, compliant boolean, violations array<string>"
TOTAL, COMPLIANT, VIOLATION = "total", "compliant", "violation"


def open_store(store: Versions) -> None:
    make = lambda schema: store.spark.createDataFrame([], schema)
    store.create(KEYS, current=make(CURRENT), counts=make("measure string, field_key string, n long"), batches=make("stream string, batch long"))


def measured(reports: DataFrame, sign: int) -> DataFrame:
    """``measure, field_key, n``: what reports count for."""
    one = lambda measure, key=None: F.struct(F.lit(measure).alias("measure"), (F.lit("") if key is None else key).alias("field_key"))
    fields = F.transform(F.array_distinct(F.coalesce("violations", F.array().cast("array<string>"))), lambda f: one(VIOLATION, f))
    all_ = F.concat(F.array(one(TOTAL)), F.when(F.col("compliant"), F.array(one(COMPLIANT))).otherwise(F.array().cast("array<struct<measure:string,field_key:string>>")), fields)
    return reports.select(F.explode(all_).alias("m")).groupBy("m.measure", "m.field_key").agg((sign * F.count(F.lit(1))).alias("n"))


def fold(store: Versions, batch: DataFrame, number: int, stream: str = "reports") -> bool:
    """Folds reports ``CURRENT`` into the store; False if the batch is folded in already.

    Of several versions of a report the largest counts; one that isn't larger than the stored one changes nothing.
    """
    manifest = store.manifest()
    done = store.read("batches", manifest).filter(F.col("stream") == stream).agg(F.max("batch")).first()[0]
    if done is not None and number <= done:
        return False
    own = ["version", "compliant", "violations"]
    newest = batch.groupBy("id").agg(F.max_by(F.struct(*own), "version").alias("row")).select("id", "row.*")
    stored = store.read("current", manifest).select("id", *[F.col(c).alias(f"old_{c}") for c in own])
    # counts, what they take back and the new rows all come from this, so the batch is read once
    both = store.aside(newest.join(stored.hint("merge"), "id", "left").filter("old_version is null or version > old_version"), "current")
    old = both.filter("old_version is not null").select("id", *[F.col(f"old_{c}").alias(c) for c in own])
    deltas = measured(both, 1).unionByName(measured(old, -1)).groupBy("measure", "field_key").agg(F.sum("n").alias("d")).filter("d <> 0")
    counts = deltas.join(store.read("counts", manifest), ["measure", "field_key"], "left").select("measure", "field_key", (F.coalesce("n", F.lit(0)) + F.col("d")).alias("n"))
    mark = store.spark.createDataFrame([(stream, number)], "stream string, batch long")
    store.commit(manifest, current=both.select("id", *own), counts=counts, batches=mark)
    return True


def dashboard(store: Versions, top: int = 5) -> DataFrame:
    """One row: total, compliant, rate in per cent (0 without any) and the commonest violations, of equal ones the first by name."""
    counts = store.read("counts")
    best = counts.filter((F.col("measure") == VIOLATION) & (F.col("n") > 0)).orderBy(F.desc("n"), "field_key").limit(top)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col("field_key").alias("field"), F.col("n").alias("count")))).alias("l"))  # top rows
    sum_of = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0))
    row = counts.agg(sum_of(TOTAL).alias("total_scanned"), sum_of(COMPLIANT).alias("compliant_count"))
    rate = F.when(F.col("total_scanned") == 0, 0.0).otherwise(F.round(100 * F.col("compliant_count") / F.col("total_scanned"), 1))
    shown = listed.select(F.transform("l", lambda x: F.struct(x["field"].alias("field"), x["count"].alias("count"))))
    return row.select("*", rate.alias("compliance_rate"), shown.scalar().alias("most_common_violations"))


def kept_up(reports: DataFrame, store: Versions, checkpoint: str):
    """Starts the stream that keeps the store up; the trigger takes what is there."""
    return reports.writeStream.foreachBatch(lambda df, n: fold(store, df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
