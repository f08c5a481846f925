"""Queries of the declaration extractors and word operators over labels made from customers, and their SQL.

A label's lines depend on the customer's key in a way that says what must be found on it, so the SQL states the expected
declarations directly.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import extract, reports, words as word_ops
from ..sources import adapters, dims
from ..sources.readers import spread, table
from .catalogue import query

adapters.SQL["labelled"] = """labelled AS (SELECT c_custkey AS id, c_custkey AS k, c_mktsegment[1] || lower(c_mktsegment[2:]) AS segment, (100 + c_custkey % 800)::VARCHAR AS q, (20 + c_custkey % 900)::VARCHAR AS p,
    lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') AS mm, '9' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS phone FROM customer)"""
adapters.SQL["label_lines"] = """label_lines AS (SELECT id, list_filter([
    CASE WHEN k % 6 < 3 THEN 'Marketed by ' || segment || ' Foods Ltd' WHEN k % 6 = 3 THEN 'Marketed ' || segment || ' Foods' END,
    CASE WHEN k % 2 = 0 THEN 'BISCUITS' ELSE 'Ingredients Salt' END, CASE k % 3 WHEN 0 THEN 'Net Weight ' || q || 'g' WHEN 1 THEN q || 'g' ELSE 'Net Weight ' || q || '9' END,
    CASE WHEN k % 2 = 0 THEN 'MRP Rs.' || p || '.00' ELSE 'Rs.' || p || '.00' END, CASE WHEN k % 4 < 3 THEN 'PKD ' || mm || '/2024' ELSE 'PKD 13/2024' END,
    CASE WHEN k % 5 < 4 THEN 'Customer Care ' || phone END], lambda x: x IS NOT NULL) AS ls FROM labelled)"""


def label_lines(spark, d):
    """``id, lines``."""
    k = F.col("c_custkey")
    segment = F.concat(F.substring("c_mktsegment", 1, 1), F.lower(F.substring("c_mktsegment", 2, 99)))
    q, p, mm = (100 + k % 800).cast("string"), (20 + k % 900).cast("string"), F.lpad((1 + k % 12).cast("string"), 2, "0")
    phone = F.concat(F.lit("9"), F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0"))
    of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    lines = F.array(
        F.when(k % 6 < 3, of("Marketed by ", segment, " Foods Ltd")).when(k % 6 == 3, of("Marketed ", segment, " Foods")), F.when(k % 2 == 0, "BISCUITS").otherwise("Ingredients Salt"),
        F.when(k % 3 == 0, of("Net Weight ", q, "g")).when(k % 3 == 1, of(q, "g")).otherwise(of("Net Weight ", q, "9")), F.when(k % 2 == 0, of("MRP Rs.", p, ".00")).otherwise(of("Rs.", p, ".00")),
        F.when(k % 4 < 3, of("PKD ", mm, "/2024")).otherwise("PKD 13/2024"), F.when(k % 5 < 4, of("Customer Care ", phone)),
    )
    return spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment")).select(k.alias("id"), F.filter(lines, lambda x: x.isNotNull()).alias("lines"))


def labels(spark, d):
    """``id, words``: lines 20 pixels apart, 8 pixels a character."""

    def line(text, n):
        found = F.split(text, " ")
        before = lambda k: F.aggregate(F.slice(found, F.lit(1), k), F.lit(0), lambda acc, x: acc + F.length(x) + 1)
        word = lambda t, k: F.struct(
            t.alias("text"), F.lit(90.0).alias("conf"), (10 + 8 * before(k)).cast("int").alias("left"), (200 + 20 * n).cast("int").alias("top"), F.greatest(F.lit(8), 8 * F.length(t)).alias("width"),
            F.lit(12).alias("height"), F.lit("paddle").alias("provider"), F.lit(None).cast("string").alias("original_text"),
        )
        return F.transform(found, word)

    return label_lines(spark, d).select("id", F.flatten(F.transform("lines", line)).alias("words"))


EXPECTED = {
    "maker": ("CASE WHEN k % 6 < 3 THEN 'FOUND' WHEN k % 6 = 3 THEN 'UNCERTAIN' ELSE 'NOT_FOUND' END", "CASE WHEN k % 6 < 4 THEN segment || ' Foods' END"),
    "product": ("CASE WHEN k % 2 = 0 THEN 'FOUND' ELSE 'NOT_FOUND' END", "CASE WHEN k % 2 = 0 THEN 'BISCUITS' END"),
    "quantity": ("CASE WHEN k % 3 = 1 THEN 'UNCERTAIN' ELSE 'FOUND' END", "q || 'g'"),
    "price": ("CASE WHEN k % 2 = 0 THEN 'FOUND' ELSE 'UNCERTAIN' END", "'Rs.' || p || '.00'"),
    "date": ("CASE WHEN k % 4 < 3 THEN 'FOUND' ELSE 'UNCERTAIN' END", "CASE WHEN k % 4 < 3 THEN mm || '/2024' END"),
    "care": ("CASE WHEN k % 5 < 4 THEN 'FOUND' ELSE 'NOT_FOUND' END", "CASE WHEN k % 5 < 4 THEN phone END"),
}


def declared(field: str, spark, d):
    return extract.declarations(labels(spark, d), fields=(field,)).select("id", "status", "value", "confidence")


for _field, (_name, (_status, _value)) in zip(dims.FIELDS, EXPECTED.items()):
    _query = partial(declared, _field)
    _query.__name__ = f"declarations_{_name}"
    query(f"SELECT id, {_status} AS status, {_value} AS value, CASE WHEN {_status} = 'NOT_FOUND' THEN 0.0 ELSE 90.0 END::DOUBLE AS confidence FROM labelled", "labelled")(_query)


@query("SELECT id, array_to_string(ls, chr(10)) AS text FROM label_lines", "labelled", "label_lines")
def rebuilt_text(spark, d):
    return word_ops.rebuilt(labels(spark, d))


@query("SELECT id, sum(len(string_split(l, ' ')))::BIGINT AS n_words, (CASE WHEN id % 2 = 0 THEN 95.0 ELSE 90.0 END)::DOUBLE AS conf FROM (SELECT id, unnest(ls) AS l FROM label_lines) GROUP BY id", "labelled", "label_lines")
def merge_words(spark, d):
    """A second pass reads every word again, three pixels to the right, surer on even labels and less sure on odd ones."""
    first = labels(spark, d)
    moved = F.transform("words", lambda w: w.withField("left", w["left"] + 3).withField("conf", F.when(F.col("id") % 2 == 0, 95.0).otherwise(80.0)))
    passes = first.withColumn("n", F.lit(0)).unionByName(first.withColumn("words", moved).withColumn("n", F.lit(1)))
    merged = word_ops.merged(passes, ["id"], "n")
    return merged.select("id", F.size("words").cast("long").alias("n_words"), F.array_max(F.transform("words", lambda w: w["conf"])).alias("conf"))


@query("""SELECT id, n::INT AS n, string_agg(t || ':' || l, ' ' ORDER BY pos) AS tokens FROM (
    SELECT id, n, pos, t, (10 + coalesce(sum(8 * (length(t) + 1)) OVER (PARTITION BY id, n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS l FROM (
        SELECT id, n, unnest(range(len(ts))) AS pos, unnest(ts) AS t FROM (SELECT id, unnest(range(len(ls))) AS n, string_split(unnest(ls), ' ') AS ts FROM label_lines))) GROUP BY id, n""", "labelled", "label_lines")
def token_boxes(spark, d):
    lines = label_lines(spark, d).select("id", F.posexplode("lines").alias("n", "text"))
    tokens = reports.token_boxes(F.col("text"), F.lit(10), 8 * F.length("text"))
    return lines.select("id", "n", F.array_join(F.transform(tokens, lambda t: F.concat_ws(":", t["text"], t["left"])), " ").alias("tokens"))
