"""Checks of arriving records: accepted and quarantined rows of one scan, with codes and counts.

Every record gets all codes that apply, in the order of the checks.  Both sides are written by one job, as partitions of one
table, and counted on the way by an observation, so the input is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Sides of a package, keys of an OCR word.
SIDES = ("back", "front", "side")
WORD_KEYS = ("conf", "height", "left", "text", "top", "width")


def filled(x: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit("")) != ""


def side_of(label: Column) -> Column:
    return F.lower(F.trim(label))


def words_of(results: Column, metadata: Column) -> Column:
    """The words of a result as an array of maps: those of its metadata, where it has any, before its bounding boxes; other shapes are no words."""
    raw = F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$.words", "variant"), F.try_parse_json(results))
    return F.coalesce(F.try_variant_get(raw, "$", "array<map<string,variant>>"), F.array().cast("array<map<string,variant>>"))


def missing_keys(word: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, WORD_KEYS)), F.map_keys(word))


def codes() -> list[tuple[str, Column]]:
    """(code, test) in order, over ``product_id, session_id, images`` (array of label, source, content_type), ``labels, words, metadata, confirmations``."""
    images, labels = F.col("images"), F.col("labels")
    of = lambda f: F.transform(F.coalesce(images, F.array().cast("array<struct<label:string,source:string,content_type:string>>")), f)
    sides = F.filter(of(lambda i: side_of(i["label"])), lambda s: s.isNotNull())
    sources = F.filter(of(lambda i: i["source"]), filled)
    kind = lambda i: F.startswith(F.coalesce(i["content_type"], F.lit("")), F.lit("image/"))
    known = lambda s: F.coalesce(s.isin(*SIDES), F.lit(False))
    confirmations = F.schema_of_variant(F.try_parse_json("confirmations"))
    return [
        ("no_image", F.coalesce(F.size(images), F.lit(0)) <= 0),
        ("label_count", labels.isNotNull() & (F.size(labels) != F.greatest(F.coalesce(F.size(images), F.lit(0)), F.lit(0)))),
        ("content_type", F.exists(images, lambda i: ~kind(i))),
        ("no_identifier", ~filled(F.col("product_id")) & ~filled(F.col("session_id"))),
        ("blank_product_id", F.col("product_id").isNotNull() & ~filled(F.col("product_id"))),
        ("blank_session_id", F.col("session_id").isNotNull() & ~filled(F.col("session_id"))),
        ("unknown_label", F.exists(of(lambda i: side_of(i["label"])), lambda s: ~known(s))),
        ("empty_source", F.exists(of(lambda i: i["source"]), lambda s: ~filled(s))),
        ("duplicate_label", F.size(F.array_distinct(sides)) < F.size(sides)),
        ("duplicate_source", F.size(F.array_distinct(sources)) < F.size(sources)),
        ("word_fields", F.exists(words_of(F.col("words"), F.col("metadata")), lambda w: F.size(missing_keys(w)) > 0)),
        ("confirmations", F.col("confirmations").isNotNull() & ~F.coalesce(F.startswith(confirmations, F.lit("OBJECT")), F.lit(False))),
    ]


CODES = ("no_image", "label_count", "content_type", "no_identifier", "blank_product_id", "blank_session_id", "unknown_label", "empty_source", "duplicate_label", "duplicate_source", "word_fields", "confirmations")


def checked(records: DataFrame) -> DataFrame:
    """Adds ``errors`` (codes in order) and ``accepted``."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), code) for code, test in codes()]))
    return records.withColumn("errors", found).withColumn("accepted", F.size("errors") == 0)


def intake(records: DataFrame, path: str) -> dict[str, int]:
    """Writes accepted and quarantined records below ``path`` and gives counts: of both, and of every code."""
    seen = Observation("intake")
    counts = [F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("quarantined")]
    counts += [F.count_if(F.array_contains("errors", code)).alias(code) for code in CODES]
    checked(records).observe(seen, *counts).write.mode("append").partitionBy("accepted").parquet(path)
    return seen.get


def stored(spark: SparkSession, path: str, accepted: bool) -> DataFrame:
    """One side; only its files are read."""
    return spark.read.parquet(path).filter(F.col("accepted") == accepted).drop("accepted")
