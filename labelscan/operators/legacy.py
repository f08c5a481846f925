"""Reports of all ages in one scan: JSON of mixed shapes, read as VARIANT and brought to one row per decision.

Newer reports have ``field_decisions`` (field -> decision); older ones only ``fields`` (field -> present, matched_text,
description).  A value of another type than expected is null, not an error; text that isn't JSON is a report without decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is said of a field that an older report found or missed.
PRESENT, MISSING, NO_RULE = "Present in the legacy report.", "Missing in the legacy report.", "-"
ROW = "struct<declaration:string,rule_id:string,status:string,extracted_value:string,confidence:double,reason:string>"


def get(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def new_decision(d: Column) -> Column:
    return F.struct(get(d, "declaration").alias("declaration"), get(d, "rule_id").alias("rule_id"), F.coalesce(get(d, "status"), F.lit("REVIEW")).alias("status"), get(d, "extracted_value").alias("extracted_value"), get(d, "confidence", "double").alias("confidence"), get(d, "reason").alias("reason"))


def old_decision(key: Column, f: Column) -> Column:
    present = F.coalesce(get(f, "present", "boolean"), F.lit(False))
    said = lambda yes, no: F.when(present, yes).otherwise(no)
    return F.struct(F.coalesce(get(f, "description"), key).alias("declaration"), F.lit(NO_RULE).alias("rule_id"), said("PASS", "VIOLATION").alias("status"), get(f, "matched_text").alias("extracted_value"), F.lit(None).cast("double").alias("confidence"), said(PRESENT, MISSING).alias("reason"))


def decisions(reports: DataFrame, report_col: str = "report") -> DataFrame:
    """The columns of ``reports`` but its JSON, with ``field_key, legacy`` and a decision's columns; a row for each decision."""
    df = reports.withColumn("_v", F.try_parse_json(report_col))
    maps = {n: F.try_variant_get("_v", f"$.{n}", "map<string,variant>") for n in ("field_decisions", "fields")}
    df = df.withColumns({f"_{n}": m for n, m in maps.items()}).withColumn("legacy", F.coalesce(F.cardinality("_field_decisions"), F.lit(0)) <= 0)
    newer, older = F.transform_values("_field_decisions", lambda k, d: new_decision(d).cast(ROW)), F.transform_values("_fields", lambda k, f: old_decision(k, f).cast(ROW))
    rows = df.select(*[c for c in reports.columns if c != report_col], "legacy", F.explode(F.when(F.col("legacy"), older).otherwise(newer)).alias("field_key", "_d"))
    return rows.select(*[c for c in rows.columns if c != "_d"], "_d.*")


def matched_words(decided: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """The box of an older decision: around the words of its report (``key, text, left, top, width, height``) that its text holds; null without any."""
    parts = F.min("left"), F.min("top"), F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    old = decided.filter("legacy and extracted_value <> ''").select(key, "field_key", F.lower("extracted_value").alias("_text"))
    hits = old.join(words, key).filter(F.contains("_text", F.lower("text"))).groupBy(key, "field_key").agg(*[p.alias(n) for p, n in zip(parts, ("left", "top", "right", "bottom"))])
    return decided.join(hits, [key, "field_key"], "left")
