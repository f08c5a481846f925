"""Views of the driver's tables as inspections, candidates, review events and OCR words, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import table

SQL = {
    "inspections": """inspections AS (
        SELECT o_orderkey AS id, o_orderpriority AS filename, c_mktsegment AS product_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'REVIEW' ELSE 'VIOLATION' END AS overall_result, o_totalprice AS price
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "candidates": """candidates AS (
        SELECT l_orderkey AS product_id, (l_linenumber % 6)::INT AS field_no, CASE l_returnflag WHEN 'A' THEN 'FOUND' WHEN 'N' THEN 'UNCERTAIN' ELSE 'NOT_FOUND' END AS status,
               l_quantity * 2 AS conf, l_suppkey AS source, (l_partkey % 7)::INT AS context_score,
               CASE WHEN l_suppkey % 3 = 0 THEN 'side' WHEN l_linestatus = 'F' THEN 'front' ELSE 'back' END AS label, l_partkey AS part FROM lineitem)""",
    "review_events": """review_events AS (
        SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'error' THEN 'VIOLATION' WHEN 'view' THEN 'REVIEW' WHEN 'signup' THEN 'PASS' ELSE 'VIOLATION' END AS decision,
               CASE WHEN event_type <> 'signup' THEN 'inspector-' || (event_id % 7)::VARCHAR END AS inspector, CASE WHEN event_type <> 'click' THEN props END AS reason FROM events)""",
    "words": r"""tokens AS (
        SELECT doc_id, line, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS word FROM (
            SELECT doc_id, line, string_split(t, ' ') AS ws FROM (
                SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
    ), placed AS (
        SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip FROM tokens
    ), words AS (
        SELECT doc_id, line::INT AS line, pos::INT AS pos, word, (10 + 8 * skip)::BIGINT AS x, ((10 + line) * 20)::BIGINT AS top,
               greatest(8, 8 * length(word))::BIGINT AS width, (12 + (doc_id + line) % 3 * 8)::BIGINT AS height, (50 + (31 * doc_id + 17 * line + 7 * pos) % 50)::BIGINT AS conf
        FROM placed WHERE word <> '')""",
}


def inspections(spark: SparkSession, d: str, *hints: str) -> DataFrame:
    """``hints``: how customers are joined."""
    customers = table(spark, d, "customer")
    for hint in hints:
        customers = customers.hint(hint)
    rows = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    result = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("VIOLATION")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("filename"), F.col("c_mktsegment").alias("product_name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), result.alias("overall_result"), F.col("o_totalprice").alias("price"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "FOUND").when(F.col("l_returnflag") == "N", "UNCERTAIN").otherwise("NOT_FOUND")
    label = F.when(F.col("l_suppkey") % 3 == 0, "side").when(F.col("l_linestatus") == "F", "front").otherwise("back")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("product_id"), (F.col("l_linenumber") % 6).alias("field_no"), status.alias("status"), (F.col("l_quantity") * 2).alias("conf"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 7).cast("int").alias("context_score"), label.alias("label"), F.col("l_partkey").alias("part"))


def review_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    decision = F.when(kind.isin("purchase", "signup"), "PASS").when(kind == "view", "REVIEW").otherwise("VIOLATION")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", decision.alias("decision"), F.when(kind != "signup", F.concat(F.lit("inspector-"), (F.col("event_id") % 7).cast("string"))).alias("inspector"), F.when(kind != "click", F.col("props")).alias("reason"))


#: Texts whose words are held at once.
TEXTS = 256


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, line, pos, word, skip`` of texts ``doc_id, text``; ``skip``: characters before the word in its line."""

    def parts(column: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces between marks, of which row each is, and its number there."""
        pieces = pc.split_pattern(column, mark)
        row = pc.list_parent_indices(pieces).to_numpy()
        return pc.list_flatten(pieces), row, np.arange(len(row)) - np.searchsorted(row, row)

    for batch in batches:
        for own in (batch.slice(k, TEXTS) for k in range(0, batch.num_rows, TEXTS)):
            lines, doc, line = parts(own.column(1), "\n")
            words, at, pos = parts(lines, " ")
            ends = np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64) + 1)
            starts = np.concatenate([[0], ends])[: len(ends)]
            skip = starts - starts[np.arange(len(pos)) - pos]
            kept = np.flatnonzero(np.diff(np.append(starts, ends[-1:])) > 1)
            numbers = [pa.array(x[kept].astype(np.int32)) for x in (line[at], pos)]
            yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(doc[at[kept]])), *numbers, words.take(pa.array(kept)), pa.array(skip[kept])], ["doc_id", "line", "pos", "word", "skip"])


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words placed inside their text's row: nothing is shuffled."""
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = texts.mapInArrow(tokens, "doc_id long, line int, pos int, word string, skip long")
    return placed.select(
        "doc_id", "line", "pos", "word", (10 + 8 * F.col("skip")).cast("long").alias("x"), ((10 + F.col("line")) * 20).cast("long").alias("top"),
        F.greatest(F.lit(8), 8 * F.length("word")).cast("long").alias("width"), (12 + (F.col("doc_id") + F.col("line")) % 3 * 8).cast("long").alias("height"),
        (50 + (31 * F.col("doc_id") + 17 * F.col("line") + 7 * F.col("pos")) % 50).cast("long").alias("conf"),
    )
