"""Queries of the report operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, history, reports, review
from ..sources import adapters, dims
from ..sources.readers import table
from .catalogue import BEST, END, START, fields_of, query

adapters.SQL["best"] = BEST


def best(spark, d):
    return decisions.best_evidence(adapters.candidates(spark, d), ["product_id", "field_no"], F.col("part"), F.col("context_score"))


FIELD_NAMES = "['" + "', '".join(dims.FIELDS) + "']"


def named_fields(spark, d):
    name = F.element_at(F.array(*map(F.lit, dims.FIELDS)), F.col("field_no") + 1)
    return best(spark, d).groupBy(F.col("product_id").alias("id")).agg(F.collect_list(F.struct(name.alias("field"), "status")).alias("fields"))


@query(f"SELECT product_id AS id, '{{' || string_agg('\"' || {FIELD_NAMES}[field_no + 1] || '\":\"' || status || '\"', ',' ORDER BY {FIELD_NAMES}[field_no + 1]) || '}}' AS summary FROM best GROUP BY 1", "candidates", "best")
def report_summary(spark, d):
    return named_fields(spark, d).select("id", reports.field_summary(F.col("fields")).alias("summary"))


@query(f"SELECT product_id AS id, {FIELD_NAMES}[field_no + 1] AS field, status FROM best", "candidates", "best")
def report_summary_decoded(spark, d):
    stored = named_fields(spark, d).select("id", reports.field_summary(F.col("fields")).alias("summary"))
    return stored.select("id", F.explode(reports.summary_of(F.col("summary"))).alias("field", "status"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'REVIEW' WHEN o_totalprice > 50000 THEN 'PASS' ELSE 'VIOLATION' END AS overall_result FROM orders")
def default_result(spark, d):
    given = F.when(F.col("o_orderstatus") == "P", "REVIEW").when(F.col("o_orderstatus") == "F", " ")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), reports.default_result(given, F.col("o_totalprice") > 50000).alias("overall_result"))


@query(f"""SELECT (SELECT string_agg(id::VARCHAR, ',') FROM (SELECT id FROM inspections WHERE overall_result = 'REVIEW' AND created_at >= '{START}T00:00:00+00:00' AND created_at <= '{END}T23:59:59.999999+00:00' ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 5)) AS keys,
    (SELECT count(*) FROM inspections WHERE overall_result = 'REVIEW' AND created_at >= '{START}T00:00:00+00:00' AND created_at <= '{END}T23:59:59.999999+00:00') AS total""", "inspections")
def page_with_total(spark, d):
    rows = adapters.inspections(spark, d)
    mine = {"status": "REVIEW", "start": START, "end": END}
    out = reports.page_and_total(history.page(rows, 10, 5, **mine), rows.filter(history.predicates(**mine)), "id")
    return out.select(F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"), "total")


@query("SELECT product_id AS id, field_no, status, conf FROM best WHERE label = 'side'", "candidates", "best")
def side_decisions(spark, d):
    return reports.from_side(best(spark, d), "side").select(F.col("product_id").alias("id"), "field_no", "status", "conf")


@query("""SELECT count(e) AS total, count(*) FILTER (ok) AS correct, (count(*) FILTER (ok))::DOUBLE / nullif(count(e), 0) AS rate, count(*) FILTER (e IS NULL AND a IS NOT NULL) AS false_positive_fields FROM (
    SELECT e, a, coalesce(pa <> '' AND (contains(pa, pe) OR contains(pe, pa)), false) AS ok FROM (SELECT *, regexp_replace(lower(e), '[^a-z0-9]', '', 'g') AS pe, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS pa FROM (
        SELECT CASE WHEN part % 4 <> 0 THEN substr(p_name, 1, 1 + (part % 30)::INT) || CASE WHEN part % 9 = 0 THEN 'x' ELSE '' END END AS e, CASE WHEN status <> 'NOT_FOUND' THEN p_name END AS a FROM best JOIN part ON part = p_partkey)))""", "candidates", "best")
def eval_accuracy(spark, d):
    rows = best(spark, d).join(table(spark, d, "part"), F.col("part") == F.col("p_partkey"))
    wanted = F.when(F.col("part") % 4 != 0, F.concat(F.substr("p_name", F.lit(1), (1 + F.col("part") % 30).cast("int")), F.when(F.col("part") % 9 == 0, "x").otherwise("")))
    expected = rows.select("product_id", "field_no", wanted.alias("expected"))
    actual = rows.select("product_id", "field_no", "status", F.when(F.col("status") != "NOT_FOUND", F.col("p_name")).alias("actual"))
    return reports.accuracy(reports.evaluated(expected, actual, ["product_id", "field_no"]))


@query("""SELECT count(*) AS images, count(*) FILTER (o_orderkey % 5 <> 0) AS paddle_usage_count, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0) AS tesseract_fallback_count,
    sum(o_orderkey % 4)::DOUBLE / sum(o_orderkey % 4 + o_orderkey % 3) AS recall, (sum(o_orderkey % 4) FILTER (o_orderkey % 5 <> 0))::DOUBLE / sum(o_orderkey % 4 + o_orderkey % 3) FILTER (o_orderkey % 5 <> 0) AS recall_processed, avg((o_orderkey % 17)::DOUBLE) AS mean_seconds FROM orders""")
def eval_run_summary(spark, d):
    k = F.col("o_orderkey")
    providers = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(F.lit("paddle"), F.lit("tesseract"))).otherwise(F.array(F.lit("paddle")))
    return reports.run_summary(table(spark, d, "orders").select(providers.alias("providers"), (k % 4).alias("found"), (k % 4 + k % 3).alias("total"), (k % 17).cast("double").alias("seconds")))


@query("""SELECT id, n > 0 AND (m < 18 OR n < 25) AND greatest(w, h) < 2600 AS enhance, CASE WHEN n > 0 AND (m < 18 OR n < 25) AND greatest(w, h) < 2600 THEN least(2.0, 2600.0 / greatest(w, h)) END::DOUBLE AS scale, n > 0 AND h >= 1500 AS lower_panel,
    n < 25 OR NOT regexp_matches(lower(t), 'mrp|retail price|net weight|net wt|net qty') AS second_provider FROM (
    SELECT o_orderkey AS id, (300 + o_orderkey % 2900)::INT AS w, (300 + o_orderkey % 1700)::INT AS h, (o_orderkey % 40)::INT AS m, (o_orderkey % 60)::INT AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'Net WT 5' ELSE o_orderpriority END AS t FROM orders)""")
def capture_plan(spark, d):
    k = F.col("o_orderkey")
    images = table(spark, d, "orders").select(
        k.alias("id"), (300 + k % 2900).cast("int").alias("width"), (300 + k % 1700).cast("int").alias("height"), (k % 40).cast("int").alias("median_height"), (k % 60).cast("int").alias("n_words"),
        F.when(k % 3 == 0, "Net WT 5").otherwise(F.col("o_orderpriority")).alias("text"),
    )
    return reports.capture_plan(images).select("id", "enhance", "scale", "lower_panel", "second_provider")


METRICS = """metrics AS (SELECT o_orderkey AS id, (350 + o_orderkey % 900)::INT AS width, (350 + o_orderkey % 1300)::INT AS height, (o_orderkey % 120)::DOUBLE AS v, (40 + o_orderkey % 210)::DOUBLE AS m, (o_orderkey % 16) / 100.0::DOUBLE AS g, (o_orderkey % 50)::DOUBLE AS c FROM orders),
    ranks AS (SELECT *, CASE WHEN least(width, height) < 400 OR width * height < 300000 THEN 2 WHEN least(width, height) < 800 OR width * height < 1000000 THEN 1 ELSE 0 END AS r1, CASE WHEN v < 35 THEN 2 WHEN v < 80 THEN 1 ELSE 0 END AS r2,
        CASE WHEN m < 50 OR m > 235 THEN 2 WHEN m < 75 OR m > 215 THEN 1 ELSE 0 END AS r3, CASE WHEN g > 0.12 THEN 2 WHEN g > 0.03 THEN 1 ELSE 0 END AS r4 FROM metrics)"""
adapters.SQL["ranks"] = METRICS


@query("""SELECT id, r1 AS resolution_rank, r2 AS blur_rank, r3 AS brightness_rank, r4 AS glare_rank, r5 AS readability_rank, s2 AS blur_score, s3 AS brightness_score, s4 AS glare_score, s5 AS readability_score, round((s1 + s2 + s3 + s4 + s5) / 5, 1) AS quality_score,
    ['GOOD', 'WARNING', 'POOR'][greatest(r1, r2, r3, r4, r5) + 1] AS status, CASE WHEN greatest(r1, r2, r3, r4, r5) = 0 THEN 'PROCEED' ELSE 'REVIEW' END AS recommendation,
    greatest(r1, r2, r3, r4, r5) = 0 OR (r2 + r3 + r4 + r5 = 0 AND r1 > 0) AS allows_ocr FROM (
    SELECT *, round(least(100, 2 * c + 0.45::DOUBLE * visual), 1) AS s5, CASE WHEN c < 12 OR visual < 50 THEN 2 WHEN c < 20 OR visual < 75 THEN 1 ELSE 0 END AS r5 FROM (SELECT *, (s1 + s2 + s3 + s4) / 4 AS visual FROM (
        SELECT *, CASE r1 WHEN 2 THEN 20.0 WHEN 1 THEN 65.0 ELSE 100.0 END::DOUBLE AS s1, round(CASE r2 WHEN 2 THEN 40 * v / 35 WHEN 1 THEN 55 + 25 * (v - 35) / 45 ELSE least(100, 80 + v / 20) END, 1) AS s2,
               round(CASE WHEN m < 50 THEN 40 * m / 50 WHEN m > 235 THEN greatest(0, 40 - 5 * (m - 235)) WHEN m < 75 THEN 55 + (m - 50) WHEN m > 215 THEN 80 - (m - 215) ELSE 100 END, 1) AS s3,
               round(greatest(0, CASE r4 WHEN 2 THEN 40 - 100 * g WHEN 1 THEN 80 - 200 * g ELSE 100 END), 1) AS s4 FROM ranks)))""", "ranks")
def quality_checks(spark, d):
    k = F.col("o_orderkey")
    metrics = table(spark, d, "orders").select(
        k.alias("id"), (350 + k % 900).cast("int").alias("width"), (350 + k % 1300).cast("int").alias("height"), (k % 120).cast("double").alias("blur"), (40 + k % 210).cast("double").alias("brightness"),
        ((k % 16) / 100.0).alias("glare"), (k % 50).cast("double").alias("contrast"),
    )
    checks = ("resolution", "blur", "brightness", "glare", "readability")
    return decisions.quality_checks(metrics).select("id", *[f"{c}_rank" for c in checks], *[f"{c}_score" for c in checks[1:]], "quality_score", "status", "recommendation", "allows_ocr")


SESSION = """moves AS (SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'create' WHEN 'purchase' THEN 'confirm' ELSE 'override' END AS action,
        CASE event_type WHEN 'signup' THEN ' review' WHEN 'view' THEN 'PASS' END AS system_status, CASE WHEN event_id % 7 > 0 THEN 'inspector' END AS inspector, CASE WHEN event_type <> 'error' THEN props END AS reason FROM events),
    asked AS (SELECT *, CASE WHEN action = 'create' AND upper(trim(system_status)) <> 'REVIEW' THEN 'not created' WHEN action = 'override' AND trim(coalesce(reason, '')) = '' THEN 'missing reason'
        WHEN action <> 'create' AND inspector IS NULL THEN 'missing identity' END AS why FROM moves),
    opened AS (SELECT *, coalesce(bool_or(action = 'create' AND why IS NULL) OVER w, false) AS made FROM asked WINDOW w AS (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    closing AS (SELECT *, CASE WHEN why IS NULL AND made AND action <> 'create' THEN action END AS closes FROM opened),
    closed AS (SELECT *, first_value(closes IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM closing),
    sessions AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN action = 'create' AND made THEN 'duplicate' WHEN action <> 'create' AND NOT made THEN 'unknown review' WHEN done = 'confirm' AND action = 'confirm' THEN 'unchanged'
        WHEN done IS NOT NULL AND action <> 'create' THEN 'already completed' ELSE 'accepted' END AS outcome FROM closed)"""
adapters.SQL["sessions"] = SESSION


def moves(spark, d):
    kind = F.col("event_type")
    action = F.when(kind.isin("signup", "view"), "create").when(kind == "purchase", "confirm").otherwise("override")
    status = F.when(kind == "signup", " review").when(kind == "view", "PASS")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", action.alias("action"), status.alias("system_status"), F.when(F.col("event_id") % 7 > 0, "inspector").alias("inspector"), F.when(kind != "error", F.col("props")).alias("reason"))


@query("""SELECT event_id, outcome, CASE WHEN coalesce(done, CASE WHEN outcome = 'accepted' THEN closes END) = 'confirm' THEN 'CONFIRMED' WHEN coalesce(done, CASE WHEN outcome = 'accepted' THEN closes END) = 'override' THEN 'OVERRIDDEN'
    WHEN made OR outcome = 'accepted' THEN 'PENDING' END AS state FROM sessions""", "sessions")
def session_reviews(spark, d):
    return review.session(moves(spark, d), "ts", "event_id").select("event_id", "outcome", "state")


@query("SELECT count(*) AS pending FROM (SELECT id FROM sessions GROUP BY id HAVING bool_or(outcome = 'accepted' AND action = 'create') AND NOT bool_or(outcome = 'accepted' AND action <> 'create'))", "sessions")
def pending_count(spark, d):
    per = review.session(moves(spark, d), "ts", "event_id").filter("outcome = 'accepted'").groupBy("id").agg(F.bool_or(F.col("action") == "create").alias("made"), F.bool_or(F.col("action") != "create").alias("done"))
    return per.agg(F.count_if(F.col("made") & ~F.col("done")).alias("pending"))


@query("SELECT user_id AS id, event_id, coalesce(upper(trim(coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE NULL END), ''), CASE WHEN event_id % 2 = 0 THEN event_type END, 'review'))) = 'REVIEW', false) AS needs_human FROM events")
def needs_human(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", F.when(k % 3 == 0, " ").alias("overall_status"), F.when(k % 2 == 0, F.col("event_type")).alias("status"), F.lit("review").alias("automated_status"))
    return rows.select("id", "event_id", reports.needs_human("overall_status", "status", "automated_status").alias("needs_human"))


@query("SELECT product_id::VARCHAR AS inspection_id, ['manufacturer_or_packer'][1] AS first_field, count(*) AS n FROM best WHERE status <> 'FOUND' GROUP BY 1", "candidates", "best")
def star_violations(spark, d):
    """Fan-out of reports that arrive twice: each inspection and violation is stored once."""
    fields = fields_of(spark, d).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "present"))).alias("fields"))
    records = fields.join(adapters.inspections(spark, d).select("id", "product_name", "created_at", "overall_result"), "id")
    star = history.fan_out(records.unionByName(records))
    return star["violations"].groupBy(F.col("inspection_id").cast("string").alias("inspection_id")).agg(F.lit(dims.FIELDS[0]).alias("first_field"), F.count(F.lit(1)).alias("n"))


@query("""SELECT id, CASE WHEN w > 0 AND h > 0 AND x + w > 0 AND y + h > 0 AND x < 500 AND y < 400 THEN concat_ws(',', greatest(0, x), greatest(0, y), least(499, x + w), least(399, y + h)) END AS corners FROM (
    SELECT o_orderkey AS id, (o_orderkey % 700 - 100)::INT AS x, (o_orderkey % 600 - 100)::INT AS y, (o_orderkey % 90)::INT AS w, (o_orderkey % 70)::INT AS h FROM orders)""")
def overlay_boxes(spark, d):
    k = F.col("o_orderkey")
    box = {"left": (k % 700 - 100).cast("int"), "top": (k % 600 - 100).cast("int"), "width": (k % 90).cast("int"), "height": (k % 70).cast("int")}
    corners = reports.clipped(box, F.lit(500), F.lit(400))
    return table(spark, d, "orders").select(k.alias("id"), corners.alias("c")).select("id", F.when(F.col("c").isNotNull(), F.concat_ws(",", "c.left", "c.top", "c.right", "c.bottom")).alias("corners"))


@query("SELECT product_id AS id, field_no, 'f' || field_no || ' - ' || status || CASE WHEN status = 'FOUND' THEN ' - ' || label ELSE '' END AS caption FROM best", "candidates", "best")
def overlay_captions(spark, d):
    text = reports.overlay_text(F.concat(F.lit("f"), F.col("field_no").cast("string")), F.col("status"), F.when(F.col("status") == "FOUND", F.col("label")).otherwise(""))
    return best(spark, d).select(F.col("product_id").alias("id"), "field_no", text.alias("caption"))


@query("""SELECT product_id AS id, field_no, CASE WHEN status = 'FOUND' THEN 'Found: ''' || label || '''' ELSE 'No matching text found anywhere on the scanned label.' END AS evidence,
    CASE WHEN status = 'FOUND' THEN 'No action needed - declaration is present.' ELSE 'Review the Legal Metrology Rules for this declaration.' END AS suggested_action FROM best""", "candidates", "best")
def explained_fields(spark, d):
    rows = best(spark, d).select(F.col("product_id").alias("id"), "field_no", (F.col("status") == "FOUND").alias("present"), F.col("label").alias("matched_text"), F.lit("rule").alias("description"), F.lit(None).cast("string").alias("action"))
    return reports.explained(rows).select("id", "field_no", "evidence", "suggested_action")
