"""Report rows, evaluation and capture planning: small relational operators around the decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean

#: The star schema of inspections; keys are derived, tables are laid out by day instead of indexed.
STAR = {
    "users": "user_id string, name string, role string",
    "products": "product_id string, item_id string, product_name string",
    "inspections": "inspection_id string, product_id string, user_id string, created_at string, compliant boolean",
    "violations": "inspection_id string, field_key string, rule_id string",
}


def aligned(df: DataFrame, schema: str) -> DataFrame:
    """``df`` as a table of ``schema``: missing columns are null, others stay behind it (additive evolution)."""
    wanted = T._parse_datatype_string(schema)
    own = [(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields]
    return df.select(*own, *[c for c in df.columns if c not in wanted.fieldNames()])


def default_result(given: Column, compliant: Column) -> Column:
    """The overall result of a report that may only say whether it is compliant."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.when(compliant, "PASS").otherwise("VIOLATION"))


def field_summary(decisions: Column) -> Column:
    """JSON of field -> status, keys sorted, of an array of (field, status)."""
    return F.to_json(F.map_from_entries(F.array_sort(F.transform(decisions, lambda x: F.struct(x["field"].alias("field"), F.coalesce(x["status"], F.lit("")).alias("status"))))))


def summary_of(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def review_reasons(decisions: Column) -> Column:
    """field -> reason of the fields under review, of a map field -> (status, reason)."""
    return F.transform_values(F.map_filter(decisions, lambda k, v: v["status"] == "REVIEW"), lambda k, v: v["reason"])


def needs_human(*statuses: str) -> Column:
    """True if the first of the columns that isn't blank says REVIEW."""
    first = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in statuses])
    return F.coalesce(F.upper(first) == "REVIEW", F.lit(False))


def from_side(evidence: DataFrame, label: str) -> DataFrame:
    """The decisions whose evidence one side of the package gave."""
    return evidence.filter(F.col("label") == label)


def page_and_total(page: DataFrame, everything: DataFrame, key: str) -> DataFrame:
    """One row: the page's keys in order and the number of all rows, of one plan; an empty page keeps the total."""
    keys = page.select(F.monotonically_increasing_id().alias("n"), key).agg(F.array_sort(F.collect_list(F.struct("n", key))).alias("rows"))  # at most a page of rows
    total = everything.agg(F.count(F.lit(1)).alias("total"))
    return keys.select(F.transform("rows", lambda r: r[key]).alias("keys"), total.scalar().alias("total"))


def placed_location(latitude: Column, longitude: Column) -> Column:
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.struct(latitude.alias("latitude"), longitude.alias("longitude")))


def plain(x: Column) -> Column:
    return clean(x)


def evaluated(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Fields with ``expected`` and ``actual`` and their category; a value counts where either contains the other, letters and digits only."""
    df = expected.join(actual, keys, "full")
    e, a = plain(F.col("expected")), plain(F.col("actual"))
    correct = F.coalesce((a != "") & (F.contains(a, e) | F.contains(e, a)), F.lit(False))
    missing = F.when(F.col("status") == "UNCERTAIN", "detected_but_low_confidence").otherwise("detected_but_extraction_missed_or_ambiguous")
    none = F.when(F.col("actual").isNull(), "absent_on_supplied_sides").otherwise("false_positive")
    return df.withColumn("category", F.when(F.col("expected").isNull(), none).when(correct, "correct").otherwise(missing))


def accuracy(evaluated_fields: DataFrame) -> DataFrame:
    """Required-field accuracy (null without any) and false positives."""
    total, hit = F.count("expected"), F.count_if(F.col("category") == "correct")
    return evaluated_fields.agg(total.alias("total"), hit.alias("correct"), F.when(total > 0, hit / total).alias("rate"), F.count_if(F.col("category") == "false_positive").alias("false_positive_fields"))


def run_summary(images: DataFrame) -> DataFrame:
    """Provider use, recall over all and over processed images, mean seconds of ``providers, found, total, seconds``."""
    used = lambda p: F.count_if(F.array_contains("providers", p))
    rate = lambda hit, all_: F.when(F.coalesce(all_, F.lit(0)) > 0, hit / all_)
    read = F.size("providers") > 0
    hit, every = F.sum("found"), F.sum("total")
    hit_read, every_read = F.sum(F.when(read, F.col("found"))), F.sum(F.when(read, F.col("total")))
    return images.agg(
        F.count(F.lit(1)).alias("images"), used("paddle").alias("paddle_usage_count"), used("tesseract").alias("tesseract_fallback_count"), rate(hit, every).alias("recall"),
        rate(hit_read, every_read).alias("recall_processed"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_seconds"),
    )


def capture_plan(images: DataFrame) -> DataFrame:
    """Which passes an image gets, of ``width, height, median_height, n_words, text``.

    Small print or few words: one enlarged pass, if the image isn't large already; a tall image: its lower half; few words or no
    price or net marker: the second provider.
    """
    # Small print 18, words 25, side 2600, tall 1500, markers.
    few, side = F.col("n_words") < 25, F.greatest("width", "height")
    marked = F.lower("text").rlike("mrp|retail price|net weight|net wt|net qty")
    df = images.withColumn("enhance", (F.col("n_words") > 0) & ((F.col("median_height") < 18) | few) & (side < 2600))
    df = df.withColumn("scale", F.when(F.col("enhance"), F.least(F.lit(2.0), 2600 / side))).withColumn("lower_panel", (F.col("n_words") > 0) & (F.col("height") >= 1500))
    return df.withColumn("second_provider", few | ~F.coalesce(marked, F.lit(False)))


def recovered_words(words: Column) -> Column:
    """Words of the second provider that are sure enough and say something."""
    return F.filter(words, lambda w: (w["conf"] >= 55) & w["text"].rlike(r"[\p{L}\p{N}]"))


def gated_words(allowed: Column, words: Column) -> Column:
    """An image that may not be read keeps its row, without words."""
    return F.when(allowed, words).otherwise(F.slice(words, 1, 0))


def zipped(images: Column, results: Column) -> Column:
    """Images and results of the same positions; what only one of them has is left out."""
    both = F.least(F.size(images), F.size(results))
    return F.slice(F.arrays_zip(images.alias("image"), results.alias("result")), F.lit(1), both)


def clipped(box: dict[str, Column], width: Column, height: Column) -> Column:
    """Corners of a box inside an image; null where it is empty or outside."""
    right, bottom = box["left"] + box["width"], box["top"] + box["height"]
    seen = (box["width"] > 0) & (box["height"] > 0) & (right > 0) & (bottom > 0) & (box["left"] < width) & (box["top"] < height)
    corners = F.struct(F.greatest(F.lit(0), box["left"]).alias("left"), F.greatest(F.lit(0), box["top"]).alias("top"), F.least(width - 1, right).alias("right"), F.least(height - 1, bottom).alias("bottom"))
    return F.when(seen, corners)


def overlaps(a: Column, b: Column) -> Column:
    """Whether rectangles of corners share area."""
    return (a["left"] < b["right"]) & (a["right"] > b["left"]) & (a["top"] < b["bottom"]) & (a["bottom"] > b["top"])


def overlay_text(name: Column, status: Column, value: Column) -> Column:
    return F.concat_ws(" - ", name, F.coalesce(status, F.lit("REVIEW")), F.nullif(value, F.lit("")))


def explained(fields: DataFrame) -> DataFrame:
    """Adds evidence and action of fields ``present, matched_text, description, action``; present ones need none."""
    # Templates.
    evidence = F.when(F.col("present"), F.concat(F.lit("Found: '"), "matched_text", F.lit("'"))).otherwise("No matching text found anywhere on the scanned label.")
    action = F.when(F.col("present"), "No action needed - declaration is present.").otherwise(F.coalesce("action", F.lit("Review the Legal Metrology Rules for this declaration.")))
    return fields.withColumn("rule_violated", F.when(~F.col("present"), F.col("description"))).withColumn("evidence", evidence).withColumn("suggested_action", action)


def polygon_box(points: Column) -> Column:
    """The box around the points (x, y) of a polygon."""
    x, y = (F.transform(points, lambda p: p[c]) for c in ("x", "y"))
    low = (F.array_min(x), F.array_min(y))
    return F.struct(low[0].alias("left"), low[1].alias("top"), (F.array_max(x) - low[0]).alias("width"), (F.array_max(y) - low[1]).alias("height"))


def token_boxes(text: Column, left: Column, width: Column) -> Column:
    """Tokens of a line's text with left edges and widths in proportion to their characters."""
    found, gaps = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.split(text, r"\S+", -1)
    length = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
    each = width / F.greatest(F.length(text), F.lit(1))

    def token(t: Column, k: Column) -> Column:
        at = length(gaps, k + 1) + length(found, k)
        return F.struct(t.alias("text"), (left + F.bround(at * each)).cast("int").alias("left"), F.greatest(F.lit(1), F.bround(F.length(t) * each)).cast("int").alias("width"))

    return F.transform(found, token)


def percent_confidence(conf: Column) -> Column:
    """Confidences of one or less are shares."""
    return F.when(conf <= 1, conf * 100).otherwise(conf)
