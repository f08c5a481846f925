"""Exact de-duplication as a stateful stream over disk-backed keyed state without expiry.

The corpus lands as narrow rows (digest, stable identifier, content locator).  A Structured Streaming
aggregation keyed by digest keeps, in RocksDB and without a watermark, one entry per digest: the row that is
held (largest identifier) with its locator, and how many rows arrived.  Micro-batches continue from the
state of earlier ones, so later deliveries are judged against everything seen before.  The drained state is read
back through the state data source.  Where the state reports hits, and only there, the whole texts of each digest are
compared (smallest against largest, combined on the map side, so that a group of any size costs a row per task); digests
that turn out to hold different texts are split by their texts.

Edge cases: a null text equals an empty one; rows that repeat an identifier are told apart by a row key, the
largest stays; a null identifier is smaller than any other; a text of any length is hashed and compared whole; columns besides
identifier and text are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: State on disk; a task closes its store when it has committed it, so open stores don't grow with the partitions.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Settings of the session that the stream's own session takes over.
INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")
#: Micro-batches that the landed files come in.
BATCHES = 3


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, locator``: the locator is the file and row of a row's content, null where rows don't come from files."""
    own = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    try:
        return docs.select(*own, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("locator"))
    except AnalysisException:
        return docs.select(*own, F.lit(None).cast("string").alias("locator"))


def drain(spark: SparkSession, landed: str, schema: T.StructType, state: str, files_per_batch: int | None) -> DataFrame:
    """Runs the landed rows through the keyed state under ``state``; returns (digest, held, n) of the drained state.

    Called again with the same ``state`` folder it takes only files that have landed since.  The stream has a session of
    its own, so its settings touch no other query.
    """
    own = spark.newSession()
    for k, v in STORE.items():
        own.conf.set(k, v)
    for k in INHERITED:
        own.conf.set(k, spark.conf.get(k))
    reader = own.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    held = reader.parquet(landed).groupBy("digest").agg(F.max(F.struct("doc_id", "row_key", "locator")).alias("held"), F.count(F.lit(1)).alias("n"))
    query = held.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.format("statestore").load(state)
    buffers = [f.name for f in kept.schema["value"].dataType.fields]
    return kept.select(F.col("key").getField("digest").alias("digest"), F.col("value").getField(buffers[0]).alias("held"), F.col("value").getField(buffers[1]).alias("n"))


def hits(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows whose digest the state has seen before, and few others: a bitmap of their digests is joined by its words.

    The bitmap has at most 2^21 words of 64 bits, which bounds the broadcast; the fuller it is, the more others pass.
    """
    seen = state.filter("n > 1")
    bits = min(1 << 27, max(1 << 16, 1 << (16 * seen.count()).bit_length()))
    place = F.xxhash64("digest").bitwiseAND(F.lit(bits - 1))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = seen.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one(F.col("at"))).alias("bits"))
    return rows.withColumn("at", place).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(words), "word").filter(F.col("bits").bitwiseAND(one(F.col("at"))) != 0).drop("at", "word", "bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batches: int = BATCHES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, row_key, locator``.

    ``digest`` may be any function of the text: collisions are found by comparing whole texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = narrow(docs, id_col, text_col)
    rows = rows.withColumn("row_key", F.monotonically_increasing_id()).withColumn("text_sha256", sha256(F.col("text"))).withColumn("digest", F.col("text_sha256") if digest is sha256 else digest(F.col("text")))
    landed = scratch.save(rows.drop("text"), "landed")
    state = drain(spark, scratch.path("landed"), landed.schema, scratch.path("state"), -(-len(landed.inputFiles()) // batches) or None)
    state = scratch.save(state, "held")
    scratch.drop("state")
    span = hits(rows, state).groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    clash = scratch.save(span.filter("low <> high").select("digest"), "clash")
    if clash.isEmpty():
        clash = None
    clear = landed if clash is None else landed.join(clash, "digest", "left_anti")
    out = clear.join(state, "digest")
    if clash is not None:
        own = rows.join(clash, "digest")
        split = own.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "row_key", "locator")).alias("held"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(own.join(split, ["digest", "text"]).drop("text"))
    return out.select(
        "doc_id", F.col("held.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("held.row_key") == F.col("row_key")).alias("kept"), "text_sha256", "row_key", "locator"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one row of each text.

    Rows from files are found by their locators, others by identifier and digest, of equal ones of which one stays.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"), F.col("locator").alias("_kept_at"))
    names, own = docs.columns, F.struct(*[F.col(c) for c in docs.columns]).alias("_kept_row")
    try:
        rows = docs.select(own, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("_kept_at"))
        out = rows.join(kept.select("_kept_at"), "_kept_at", "left_semi")
    except AnalysisException:
        rows = docs.select(own, F.col(id_col).alias("_id"), sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("_sha"))
        out = rows.join(kept, rows["_id"].eqNullSafe(kept["_kept_id"]) & (rows["_sha"] == kept["_kept_sha"]), "left_semi").dropDuplicates(["_id", "_sha"])
    return out.select(*[F.col("_kept_row").getField(n).alias(n) for n in names])
