"""Evidence selection, decisions, overall result, readability, score and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dims import LABELS, OTHER_ACTION


def status_rank() -> Column:
    return F.when(F.col("status") == "FOUND", 2).when(F.col("status") == "UNCERTAIN", 1).otherwise(0)


def label_rank() -> Column:
    return F.when(F.col("label") == "front", 2).when(F.col("label") == "back", 1).otherwise(0)


def best_evidence(candidates: DataFrame, keys: list[str], *ties: Column) -> DataFrame:
    """The best candidate of each field: status, confidence, context, side, source; the first wins a full tie."""
    order = [status_rank().desc(), F.desc("conf"), F.desc("context_score"), label_rank().desc(), F.desc("source"), *ties]
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def coverage(images: DataFrame) -> DataFrame:
    """complete if a product has all three sides."""
    sides = [F.bool_or(F.col("label") == s) for s in LABELS]
    return images.groupBy("product_id").agg(F.when(sides[0] & sides[1] & sides[2], "complete").otherwise("incomplete").alias("coverage_status"))


def sufficient_quality(words: DataFrame, product: str, source: str) -> DataFrame:
    """True if every source's known confidences average 60 or more; a source without any makes it false."""
    per = words.groupBy(product, source).agg(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("mean"))
    return per.groupBy(product).agg(F.every(F.coalesce(F.col("mean") >= 60, F.lit(False))).alias("sufficient"))


def decide(fields: DataFrame) -> DataFrame:
    """Adds ``decision`` and ``decision_reason`` to ``status, reason, complete, sufficient``."""
    status = (
        F.when(F.col("status") == "FOUND", "PASS")
        .when((F.col("status") == "UNCERTAIN") | ~F.col("complete") | ~F.col("sufficient"), "REVIEW")
        .otherwise("VIOLATION")
    )
    # Reasons.
    reason = (
        F.when(F.col("status") == "FOUND", F.col("reason"))
        .when(F.col("status") == "UNCERTAIN", F.concat("reason", F.lit(" Inspector confirmation is required.")))
        .when(~F.col("complete"), "Declaration was not found, but package-side coverage is incomplete; it may appear on another side.")
        .when(~F.col("sufficient"), "Declaration was not found, but OCR/image quality is insufficient to confirm an absence.")
        .otherwise("Potential violation pending inspector confirmation: declaration was not found after complete package coverage and sufficient OCR quality.")
    )
    return fields.withColumn("decision", status).withColumn("decision_reason", reason)


def overall(decisions: DataFrame, key: str) -> DataFrame:
    """VIOLATION before REVIEW before PASS."""
    worst = F.max(F.when(F.col("decision") == "VIOLATION", 2).when(F.col("decision") == "REVIEW", 1).otherwise(0))
    return decisions.groupBy(key).agg(worst.alias("_w"), F.count(F.lit(1)).alias("n_fields")).select(key, F.element_at(F.array(*map(F.lit, ("PASS", "REVIEW", "VIOLATION"))), F.col("_w") + 1).alias("overall_result"), "n_fields")


def readability_flags(words: DataFrame, product: str) -> DataFrame:
    """Words with a digit that are small beside the product's tallest word or read with little confidence."""
    tallest = F.max("height").over(Window.partitionBy(product))
    df = words.withColumn("ratio", F.when(tallest > 0, F.col("height") / tallest)).filter(F.col("word").rlike("[0-9]"))
    small, unsure = F.coalesce(F.col("ratio") < 0.35, F.lit(False)), F.col("conf") < 70
    return df.withColumn("is_small", small).withColumn("is_low_conf", unsure).filter("is_small or is_low_conf")


def score(fields: DataFrame, extras: DataFrame, key: str = "id") -> DataFrame:
    """Score and grade of reports ``id, severity, present`` with ``id, overall_result, n_flags, n_notes``; null while under review."""
    pools = {"critical": 80.0, "moderate": 20.0}
    earned = sum(
        F.coalesce(F.when(F.count_if(F.col("severity") == s) > 0, points * F.count_if((F.col("severity") == s) & F.col("present")) / F.count_if(F.col("severity") == s)), F.lit(0.0))
        for s, points in pools.items()
    )
    df = extras.join(fields.groupBy(key).agg(earned.alias("base")), key, "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    value = F.greatest(F.lit(0), F.bround(F.col("base") - F.least(5 * F.col("n_flags"), F.lit(20)) - F.least(2 * F.col("n_notes"), F.lit(10)))).cast("int")
    df = df.withColumn("pending_review", F.col("overall_result") == "REVIEW").withColumn("score", F.when(~F.col("pending_review"), value))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").when(F.col("score").isNotNull(), "F")
    return df.withColumn("grade", grade)


def category_points(fields: DataFrame, key: str = "id") -> DataFrame:
    """Points a field could and did earn; a severity's pool is shared by its fields."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key, "severity"))
    possible = F.when(F.col("severity") == "critical", 80.0).otherwise(20.0) / n
    return fields.withColumn("points_possible", possible).withColumn("points_earned", F.when(F.col("present"), possible).otherwise(0.0))


def explanations(fields: DataFrame, actions: DataFrame) -> DataFrame:
    """What was violated, the evidence and what to do, for fields that aren't present."""
    missing = fields.filter(~F.col("present"))
    # six rows
    out = missing.join(F.broadcast(actions), "rule_key", "left")
    return out.withColumn("evidence", F.lit("No matching text found anywhere on the scanned label.")).withColumn("suggested_action", F.coalesce("action", F.lit(OTHER_ACTION))).withColumnRenamed("description", "rule_violated").drop("action")


def preferred_label(labels: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """The label with most selected evidence, the earliest image on ties; ``labels``: key, label, pos."""
    counts = evidence.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    ranked = labels.join(counts, [key, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.groupBy(key).agg(F.max(F.struct("n", (-F.col("pos")).alias("p"), "label")).alias("m")).select(key, F.col("m.label").alias("label"), F.col("m.n").alias("n"))


def quality_checks(metrics: DataFrame) -> DataFrame:
    """Five checks from ``width, height, blur, brightness, glare, contrast`` of an image, the worst status and the mean score."""
    side, area = F.least("width", "height"), F.col("width") * F.col("height")
    v, m, g, c = (F.col(x) for x in ("blur", "brightness", "glare", "contrast"))
    one = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 1)
    # Thresholds of the checks.
    scores = {
        "resolution": F.when((side < 400) | (area < 300_000), 20.0).when((side < 800) | (area < 1_000_000), 65.0).otherwise(100.0),
        "blur": F.when(v < 35, 40 * v / 35).when(v < 80, 55 + 25 * (v - 35) / 45).otherwise(80 + v / 20),
        "brightness": F.when(m < 50, 40 * m / 50).when(m > 235, F.greatest(F.lit(0.0), 40 - 5 * (m - 235))).when(m < 75, 55 + (m - 50)).when(m > 215, 80 - (m - 215)).otherwise(100.0),
        "glare": F.when(g > 0.12, 40 - 100 * g).when(g > 0.03, 80 - 200 * g).otherwise(100.0),
    }
    ranks = {
        "resolution": F.when((side < 400) | (area < 300_000), 2).when((side < 800) | (area < 1_000_000), 1).otherwise(0),
        "blur": F.when(v < 35, 2).when(v < 80, 1).otherwise(0),
        "brightness": F.when((m < 50) | (m > 235), 2).when((m < 75) | (m > 215), 1).otherwise(0),
        "glare": F.when(g > 0.12, 2).when(g > 0.03, 1).otherwise(0),
    }
    df = metrics.withColumns({f"{k}_score": one(x) for k, x in scores.items()} | {f"{k}_rank": x for k, x in ranks.items()})
    s = sum(F.col(f"{k}_score") for k in scores) / 4
    df = df.withColumn("readability_score", one(2 * c + 0.45 * s)).withColumn("readability_rank", F.when((c < 12) | (s < 50), 2).when((c < 20) | (s < 75), 1).otherwise(0))
    checks = [*scores, "readability"]
    worst = F.greatest(*[F.col(f"{k}_rank") for k in checks])
    df = df.withColumn("status", F.element_at(F.array(*map(F.lit, ("GOOD", "WARNING", "POOR"))), worst + 1))
    df = df.withColumn("quality_score", F.round(sum(F.col(f"{k}_score") for k in checks) / 5, 1)).withColumn("recommendation", F.when(F.col("status") == "GOOD", "PROCEED").otherwise("REVIEW"))
    others = sum(F.col(f"{k}_rank") for k in checks if k != "resolution") == 0
    return df.withColumn("allows_ocr", (F.col("recommendation") == "PROCEED") | (others & (F.col("resolution_rank") > 0)))


def pixel_metrics(images: DataFrame) -> DataFrame:
    """``blur, brightness, glare, contrast`` of grey images ``width, height, pixels`` (bytes, row by row)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for w, h, raw in zip(pdf["width"], pdf["height"], pdf["pixels"]):
                g = np.frombuffer(raw, np.uint8).reshape(h, w).astype(np.float64)
                p = np.pad(g, 1, mode="reflect") if min(w, h) > 1 else np.pad(g, 1, mode="edge")
                laplace = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
                out.append((laplace.var(), g.mean(), (g >= 250).mean(), g.std()))
            yield pd.concat([pdf.drop(columns="pixels").reset_index(drop=True), pd.DataFrame(out, columns=["blur", "brightness", "glare", "contrast"], dtype="float64")], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.schema if f.name != "pixels")
    return images.mapInPandas(run, f"{schema}, blur double, brightness double, glare double, contrast double")
