"""The query catalogue: every relational operator over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import decisions, history, review, words as word_ops
from ..sources import adapters, dims
from ..sources.readers import source_identity, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
START, END = "1997-01-01", "1998-06-30"


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name; ``views`` are put before the SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(adapters.SQL[v] for v in views)} " if views else "") + sql
        return f

    return keep


def fields_of(spark: SparkSession, d: str) -> DataFrame:
    """Selected evidence as report fields: product, rule and whether it is present."""
    best = decisions.best_evidence(adapters.candidates(spark, d), ["product_id", "field_no"], F.col("part"), F.col("context_score"))
    rules = dims.rules(spark).withColumn("field_no", F.array_position(F.array(*map(F.lit, dims.FIELDS)), F.col("field_key")).cast("int") - 1)
    return best.join(F.broadcast(rules), "field_no").select(F.col("product_id").alias("id"), "rule_key", "field_key", "rule_id", "description", "severity", (F.col("status") == "FOUND").alias("present"))


BEST = """best AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY product_id, field_no ORDER BY CASE status WHEN 'FOUND' THEN 2 WHEN 'UNCERTAIN' THEN 1 ELSE 0 END DESC,
    conf DESC, context_score DESC, CASE label WHEN 'front' THEN 2 WHEN 'back' THEN 1 ELSE 0 END DESC, source DESC, part) = 1)"""
RULES = "rules(field_no, rule_key, rule_id, severity) AS (VALUES " + ", ".join(f"({i}, '{r[0]}', '{r[2]}', '{r[4]}')" for i, r in enumerate(dims.RULES)) + ")"
FIELDS = f"{BEST}, {RULES}, fields AS (SELECT product_id AS id, rule_key, rule_id, severity, status = 'FOUND' AS present FROM best JOIN rules USING (field_no))"
COUNTS = "count(*) FILTER (overall_result = 'PASS') AS n_pass, count(*) FILTER (overall_result = 'REVIEW') AS n_review, count(*) FILTER (overall_result = 'VIOLATION') AS n_violation"


# -- history ----------------------------------------------------------------------------------------------------------


@query("SELECT s AS overall_result, count(id) AS n FROM (VALUES ('PASS'), ('REVIEW'), ('VIOLATION')) k(s) LEFT JOIN inspections ON overall_result = s GROUP BY s", "inspections")
def status_counts_zero_filled(spark, d):
    return history.status_counts(adapters.inspections(spark, d))


@query(f"SELECT *, n_pass + n_review + n_violation AS total, n_review / (n_pass + n_review + n_violation) AS review_rate, n_violation / (n_pass + n_review + n_violation) AS violation_rate FROM (SELECT {COUNTS} FROM inspections)", "inspections")
def history_rates(spark, d):
    return history.rates(adapters.inspections(spark, d))


@query(f"SELECT created_at[1:10] AS date, {COUNTS}, count(*) AS total FROM inspections GROUP BY date ORDER BY date DESC LIMIT 30", "inspections")
def daily_trend(spark, d):
    return history.daily_trend(adapters.inspections(spark, d), 30)


@query("SELECT * FROM inspections WHERE (contains(lower(filename), 'urg') OR contains(lower(product_name), 'urg') OR contains(id::VARCHAR, 'urg')) AND overall_result = 'PASS' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10", "inspections")
def history_page(spark, d):
    return history.page(adapters.inspections(spark, d), 20, 10, query="URG", status="pass")


@query("SELECT count(*) AS total FROM inspections WHERE contains(lower(filename), 'high') OR contains(lower(product_name), 'high') OR contains(id::VARCHAR, 'high')", "inspections")
def history_count(spark, d):
    return history.count(adapters.inspections(spark, d), query="High")


@query("SELECT id, filename, product_name FROM inspections WHERE contains(lower(filename), 'build') OR contains(lower(product_name), 'build') OR contains(id::VARCHAR, 'build')", "inspections")
def history_search(spark, d):
    return adapters.inspections(spark, d).filter(history.predicates(query="build")).select("id", "filename", "product_name")


@query("SELECT id, created_at FROM inspections WHERE overall_result = 'VIOLATION'", "inspections")
def status_filter(spark, d):
    return adapters.inspections(spark, d).filter(history.predicates(status="violation")).select("id", "created_at")


@query(f"SELECT id, created_at FROM inspections WHERE created_at >= '{START}T00:00:00+00:00' AND created_at <= '{END}T23:59:59.999999+00:00'", "inspections")
def date_range(spark, d):
    return adapters.inspections(spark, d).filter(history.predicates(start=START, end=END)).select("id", "created_at")


@query("SELECT * FROM inspections WHERE id = 7", "inspections")
def point_lookup(spark, d):
    return adapters.inspections(spark, d).filter("id = 7")


@query("SELECT id, event_id, decision, inspector, reason FROM review_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1", "review_events")
def latest_upsert(spark, d):
    return history.latest(adapters.review_events(spark, d), "id", "ts", "event_id").select("id", "event_id", "decision", "inspector", "reason")


@query("""SELECT id, event_id FROM review_events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, event_id) = 1
    UNION ALL SELECT id, event_id FROM review_events WHERE event_id % 2 = 1 AND id NOT IN (SELECT id FROM review_events WHERE event_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, event_id) = 1""", "review_events")
def insert_or_ignore(spark, d):
    events = adapters.review_events(spark, d).select("id", "ts", "event_id")
    stored = history.insert_or_ignore(events.limit(0), events.filter("event_id % 2 = 0"), "id", "ts", "event_id")
    return history.insert_or_ignore(stored, events.filter("event_id % 2 = 1"), "id", "ts", "event_id").select("id", "event_id")


@query("SELECT id, overall_result, coalesce(n, 0) AS n_fields FROM inspections LEFT JOIN (SELECT product_id AS id, count(*) AS n FROM candidates GROUP BY 1) USING (id)", "inspections", "candidates")
def history_left_join(spark, d):
    live = adapters.candidates(spark, d).groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return adapters.inspections(spark, d).join(live, "id", "left").select("id", "overall_result", F.coalesce("n", F.lit(0)).alias("n_fields"))


FOLD = """checked AS (SELECT *, CASE WHEN coalesce(trim(inspector), '') = '' THEN 'missing identity' WHEN decision <> 'REVIEW' AND coalesce(trim(reason), '') = '' THEN 'missing reason' END AS why FROM review_events),
    ended AS (SELECT *, coalesce(sum((why IS NULL AND decision <> 'REVIEW')::INT) OVER (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS over FROM checked),
    folded AS (SELECT *, coalesce(why, CASE WHEN over THEN 'not pending' ELSE 'accepted' END) AS outcome FROM ended)"""
adapters.SQL["folded"], adapters.SQL["best"], adapters.SQL["fields"] = FOLD, BEST, FIELDS


def folded(spark, d):
    return review.durable(adapters.review_events(spark, d), "ts", "event_id")


@query("""SELECT id, CASE WHEN min(event_id) FILTER (outcome = 'accepted' AND decision <> 'REVIEW') IS NULL THEN 'PENDING' ELSE 'RESOLVED' END AS state,
    arg_min(decision, (ts, event_id)) FILTER (outcome = 'accepted' AND decision <> 'REVIEW') AS final_decision, arg_min(inspector, (ts, event_id)) FILTER (outcome = 'accepted' AND decision <> 'REVIEW') AS inspector,
    count(*) FILTER (outcome = 'accepted') AS n_audit, count(*) FILTER (outcome <> 'accepted') AS n_rejected FROM folded GROUP BY id""", "review_events", "folded")
def review_first_resolution(spark, d):
    return review.resolutions(folded(spark, d), "ts", "event_id")


@query("SELECT id, event_id, outcome FROM folded", "review_events", "folded")
def review_outcomes(spark, d):
    return folded(spark, d).select("id", "event_id", "outcome")


@query("SELECT id, string_agg(CASE decision WHEN 'REVIEW' THEN 'retain_review' ELSE 'resolve' END || ':' || inspector, ',' ORDER BY ts, event_id) AS trail FROM folded WHERE outcome = 'accepted' GROUP BY id", "review_events", "folded")
def review_audit_trail(spark, d):
    trail = review.audit_trail(folded(spark, d), "ts", "event_id")
    return trail.select("id", F.array_join(F.transform("trail", lambda e: F.concat_ws(":", e["action"], e["inspector"])), ",").alias("trail"))


@query("SELECT id FROM folded GROUP BY id HAVING NOT bool_or(outcome = 'accepted' AND decision <> 'REVIEW') ORDER BY id", "review_events", "folded")
def pending_reviews(spark, d):
    return review.resolutions(folded(spark, d), "ts", "event_id").filter("state = 'PENDING'").select("id").orderBy("id")


@query("""SELECT id, overall_result, coalesce(final, 'none') AS final_decision FROM inspections LEFT JOIN (
    SELECT id, arg_min(decision, (ts, event_id)) FILTER (outcome = 'accepted' AND decision <> 'REVIEW') AS final FROM folded GROUP BY id) USING (id)""", "inspections", "review_events", "folded")
def history_with_review(spark, d):
    done = review.resolutions(folded(spark, d), "ts", "event_id").select("id", "final_decision")
    return history.with_reviews(adapters.inspections(spark, d).select("id", "overall_result"), done).withColumn("final_decision", F.coalesce("final_decision", F.lit("none")))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS compliant FROM orders GROUP BY month")
def monthly_trend(spark, d):
    return history.monthly_trend(adapters.inspections(spark, d))


@query("SELECT count(*) AS total_scanned, count(*) FILTER (overall_result = 'PASS') AS compliant_count, 100.0 * count(*) FILTER (overall_result = 'PASS') / count(*) AS compliance_rate FROM inspections", "inspections")
def dashboard_rate(spark, d):
    return history.dashboard(adapters.inspections(spark, d))


# -- decisions --------------------------------------------------------------------------------------------------------


@query("SELECT product_id, field_no, status, conf, context_score, label, source FROM best", "candidates", "best")
def evidence_argmax(spark, d):
    return decisions.best_evidence(adapters.candidates(spark, d), ["product_id", "field_no"], F.col("part")).select("product_id", "field_no", "status", "conf", "context_score", "label", "source")


@query("SELECT product_id, CASE WHEN count(DISTINCT label) = 3 THEN 'complete' ELSE 'incomplete' END AS coverage_status FROM candidates GROUP BY product_id", "candidates")
def coverage_status(spark, d):
    return decisions.coverage(adapters.candidates(spark, d))


@query("SELECT product_id, bool_and(mean >= 60) AS sufficient FROM (SELECT product_id, source, avg(conf) AS mean FROM candidates GROUP BY ALL) GROUP BY product_id", "candidates")
def ocr_quality(spark, d):
    return decisions.sufficient_quality(adapters.candidates(spark, d), "product_id", "source")


DECIDED = """sides AS (SELECT product_id, count(DISTINCT label) = 3 AS complete FROM candidates GROUP BY 1),
    quality AS (SELECT product_id, bool_and(mean >= 60) AS sufficient FROM (SELECT product_id, source, avg(conf) AS mean FROM candidates GROUP BY ALL) GROUP BY 1),
    decided AS (SELECT product_id, field_no, CASE WHEN status = 'FOUND' THEN 'PASS' WHEN status = 'UNCERTAIN' OR NOT complete OR NOT sufficient THEN 'REVIEW' ELSE 'VIOLATION' END AS decision
        FROM best JOIN sides USING (product_id) JOIN quality USING (product_id))"""
adapters.SQL["decided"] = DECIDED


def decided(spark, d):
    rows = adapters.candidates(spark, d)
    best = decisions.best_evidence(rows, ["product_id", "field_no"], F.col("part"))
    sides = decisions.coverage(rows).select("product_id", (F.col("coverage_status") == "complete").alias("complete"))
    joined = best.join(sides, "product_id").join(decisions.sufficient_quality(rows, "product_id", "source"), "product_id")
    return decisions.decide(joined.withColumn("reason", F.lit("Selected.")))


@query("SELECT product_id, field_no, decision FROM decided", "candidates", "best", "decided")
def field_decisions(spark, d):
    return decided(spark, d).select("product_id", "field_no", "decision")


@query("SELECT product_id, CASE WHEN bool_or(decision = 'VIOLATION') THEN 'VIOLATION' WHEN bool_or(decision = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS overall_result, count(*) AS n_fields FROM decided GROUP BY 1", "candidates", "best", "decided")
def overall_rollup(spark, d):
    return decisions.overall(decided(spark, d), "product_id")


@query("SELECT id, rule_key, rule_id, severity, present FROM fields", "candidates", "fields")
def rules_lookup(spark, d):
    return fields_of(spark, d).select("id", "rule_key", "rule_id", "severity", "present")


@query("SELECT rule_key, count(*) AS n FROM fields WHERE NOT present GROUP BY rule_key ORDER BY n DESC, rule_key LIMIT 5", "candidates", "fields")
def top_violations(spark, d):
    return fields_of(spark, d).filter("not present").groupBy("rule_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_key").limit(5)


ACTIONS = "actions(rule_key, suggested_action) AS (VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in dims.ACTIONS) + ")"
adapters.SQL["actions"] = ACTIONS


@query("SELECT id, rule_key, suggested_action, 'No matching text found anywhere on the scanned label.' AS evidence FROM fields JOIN actions USING (rule_key) WHERE NOT present", "candidates", "fields", "actions")
def explanations(spark, d):
    return decisions.explanations(fields_of(spark, d), dims.actions(spark)).select("id", "rule_key", "suggested_action", "evidence")


@query("SELECT rule_key, coalesce(suggested_action, 'none') AS action, n FROM (SELECT rule_key, count(*) AS n FROM fields WHERE NOT present GROUP BY rule_key) LEFT JOIN actions USING (rule_key)", "candidates", "fields", "actions")
def action_lookup(spark, d):
    missing = fields_of(spark, d).filter("not present").groupBy("rule_key").agg(F.count(F.lit(1)).alias("n"))
    return missing.join(F.broadcast(dims.actions(spark)), "rule_key", "left").select("rule_key", F.coalesce("action", F.lit("none")).alias("action"), "n")


@query("""SELECT id, pending AS pending_review, CASE WHEN NOT pending THEN score END AS score, CASE WHEN pending THEN NULL WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM (
    SELECT id, overall_result = 'REVIEW' AS pending, greatest(0, round_even(coalesce(base, 0) - least(5 * (id % 6), 20) - least(2 * (1 + id % 3), 10), 0))::INT AS score FROM inspections LEFT JOIN (
        SELECT id, coalesce(80.0::DOUBLE * count(*) FILTER (severity = 'critical' AND present) / nullif(count(*) FILTER (severity = 'critical'), 0), 0) + coalesce(20.0::DOUBLE * count(*) FILTER (severity = 'moderate' AND present) / nullif(count(*) FILTER (severity = 'moderate'), 0), 0) AS base
        FROM fields GROUP BY id) USING (id))""", "inspections", "candidates", "fields")
def score_grade(spark, d):
    extras = adapters.inspections(spark, d).select("id", "overall_result", (F.col("id") % 6).alias("n_flags"), (1 + F.col("id") % 3).alias("n_notes"))
    return decisions.score(fields_of(spark, d), extras).select("id", "pending_review", "score", "grade")


@query("SELECT id, rule_key, p AS points_possible, CASE WHEN present THEN p ELSE 0.0 END AS points_earned FROM (SELECT *, CASE severity WHEN 'critical' THEN 80.0::DOUBLE ELSE 20.0::DOUBLE END / count(*) OVER (PARTITION BY id, severity) AS p FROM fields)", "candidates", "fields")
def category_points(spark, d):
    return decisions.category_points(fields_of(spark, d)).select("id", "rule_key", "points_possible", "points_earned")


@query("""SELECT product_id, arg_max(label, (n, -pos)) AS label, max(n) AS n FROM (SELECT product_id, label, pos, count(field_no) AS n FROM (SELECT DISTINCT product_id, label, CASE label WHEN 'front' THEN 0 WHEN 'back' THEN 1 ELSE 2 END AS pos FROM candidates)
    LEFT JOIN best USING (product_id, label) GROUP BY ALL) GROUP BY product_id""", "candidates", "best")
def preferred_label(spark, d):
    rows = adapters.candidates(spark, d)
    labels = rows.select("product_id", "label").distinct().withColumn("pos", F.when(F.col("label") == "front", 0).when(F.col("label") == "back", 1).otherwise(2))
    return decisions.preferred_label(labels, decisions.best_evidence(rows, ["product_id", "field_no"], F.col("part")), "product_id")


@query("SELECT product_id, label, count(*) AS n FROM (SELECT DISTINCT product_id, label, source FROM candidates) GROUP BY ALL HAVING count(*) > 1", "candidates")
def duplicate_label_check(spark, d):
    return adapters.candidates(spark, d).select("product_id", "label", "source").distinct().groupBy("product_id", "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT id, field_no, coalesce(max(s), 'NOT_FOUND') AS status FROM (SELECT id, unnest(range(6))::INT AS field_no FROM inspections) LEFT JOIN (SELECT product_id AS id, field_no, status AS s FROM candidates) USING (id, field_no) GROUP BY ALL", "inspections", "candidates")
def union_candidates(spark, d):
    empty = adapters.inspections(spark, d).select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("field_no"))
    rows = empty.withColumn("s", F.lit(None).cast("string")).unionByName(adapters.candidates(spark, d).join(adapters.inspections(spark, d).select(F.col("id").alias("product_id")), "product_id").select(F.col("product_id").alias("id"), "field_no", F.col("status").alias("s")))
    return rows.groupBy("id", "field_no").agg(F.coalesce(F.max("s"), F.lit("NOT_FOUND")).alias("status"))


@query("SELECT sha256('source:' || chr(0) || o_orderpriority) AS source_identity, count(*) AS n FROM orders GROUP BY 1")
def sha_identity(spark, d):
    return table(spark, d, "orders").groupBy(source_identity(F.col("o_orderpriority")).alias("source_identity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_summary(spark, d):
    return table(spark, d, "events").select("event_id", F.element_at(F.from_json("props", "map<string,bigint>"), "k").alias("k"))


@query("""SELECT a.status AS expected, b.status AS actual, count(*) AS n FROM best a JOIN best b ON a.product_id = b.product_id AND b.field_no = (a.field_no + 1) % 6 GROUP BY ALL""", "candidates", "best")
def status_confusion(spark, d):
    best = decisions.best_evidence(adapters.candidates(spark, d), ["product_id", "field_no"], F.col("part")).select("product_id", "field_no", "status")
    other = best.select("product_id", ((F.col("field_no") + 5) % 6).alias("field_no"), F.col("status").alias("actual"))
    return best.join(other, ["product_id", "field_no"]).groupBy(F.col("status").alias("expected"), "actual").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT quality AS expected, (n_chars >= 400)::INT AS actual, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_confusion(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy(F.col("quality").alias("expected"), (F.col("n_chars") >= 400).cast("int").alias("actual")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS total, count(*) FILTER (contains(text, needle)) AS found, (count(*) FILTER (contains(text, needle)))::DOUBLE / count(*) AS recall
    FROM labels JOIN (SELECT doc_id, text, lang AS needle FROM documents) USING (doc_id)""")
def eval_recall(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("needle")), "doc_id")
    found = F.count_if(F.contains("text", F.col("needle")))
    return rows.agg(F.count(F.lit(1)).alias("total"), found.alias("found"), F.when(F.count(F.lit(1)) > 0, found / F.count(F.lit(1))).alias("recall"))


# -- words and text ---------------------------------------------------------------------------------------------------


@query("SELECT * FROM words", "words")
def word_explode(spark, d):
    return adapters.words(spark, d)


@query("SELECT doc_id, line, string_agg(word, ' ' ORDER BY x, pos) AS text, count(*) AS n_words, avg(conf) AS mean_conf FROM words GROUP BY doc_id, line", "words")
def line_text(spark, d):
    return word_ops.line_text(adapters.words(spark, d))


@query("SELECT doc_id, line, min(x) AS box_left, min(top) AS box_top, max(x + width) - min(x) AS box_width, max(top + height) - min(top) AS box_height FROM words GROUP BY doc_id, line", "words")
def bbox_union(spark, d):
    return word_ops.boxes(adapters.words(spark, d))


@query("SELECT doc_id, line, pos, height / tallest < 0.35 AS is_small, conf < 70 AS is_low_conf FROM (SELECT *, max(height) OVER (PARTITION BY doc_id) AS tallest FROM words) WHERE regexp_matches(word, '[0-9]') AND (height / tallest < 0.35 OR conf < 70)", "words")
def readability_flags(spark, d):
    return decisions.readability_flags(adapters.words(spark, d), "doc_id").select("doc_id", "line", "pos", "is_small", "is_low_conf")


@query("SELECT doc_id, list_sort(list(height))[count(*) // 2 + 1] AS median_height FROM words GROUP BY doc_id", "words")
def upper_median_height(spark, d):
    return word_ops.upper_median_height(adapters.words(spark, d))


VALUES_SQL = "digits AS (SELECT * FROM words WHERE regexp_matches(word, '[0-9]')), marks AS (SELECT * FROM words WHERE contains(word, '@')), spread AS (SELECT sqrt((a.x + a.width / 2 - m.x - m.width / 2) ** 2 + (a.top + a.height / 2 - m.top - m.height / 2) ** 2) AS distance, a.doc_id, a.line, a.pos, a.word, a.x + a.width / 2 AS cx, a.top + a.height / 2 AS cy, a.top, a.height, m.x + m.width / 2 AS mx, m.top + m.height / 2 AS my, m.height AS mh, m.top AS mtop, m.line AS marker_line, m.pos AS marker_pos, m.word AS marker FROM digits a JOIN (SELECT *, unnest(range(line - 13, line + 14)) AS near FROM marks) m ON a.doc_id = m.doc_id AND a.line = m.near)"
adapters.SQL["spread"] = VALUES_SQL


def digits_and_marks(spark, d):
    w = adapters.words(spark, d)
    return w.filter(F.col("word").rlike("[0-9]")), w.filter(F.contains("word", F.lit("@")))


@query("""SELECT doc_id, line, pos, word, marker_line, marker_pos, marker, distance FROM spread WHERE distance <= 180 AND CASE WHEN abs(cy - my) <= greatest(16, height, mh) THEN cx >= mx - 12 ELSE cy >= my - 8 AND cx >= mx - 50 AND cx <= mx + 180 END
    QUALIFY row_number() OVER (PARTITION BY doc_id, line, pos ORDER BY distance, marker_line, marker_pos) = 1""", "words", "spread")
def spatial_nearest_marker(spark, d):
    return word_ops.nearest(*digits_and_marks(spark, d), 180)


@query("SELECT DISTINCT doc_id, line, pos, word FROM words w WHERE EXISTS (FROM digits a WHERE a.doc_id = w.doc_id AND abs(a.x + a.width / 2 - w.x - w.width / 2) <= 350 AND abs(a.top + a.height / 2 - w.top - w.height / 2) <= 90)", "words", "spread")
def spatial_semi(spark, d):
    w = adapters.words(spark, d)
    return word_ops.nearby(w, w.filter(F.col("word").rlike("[0-9]"))).select("doc_id", "line", "pos", "word")


adapters.SQL["numbers"] = "numbers AS MATERIALIZED (SELECT * FROM words WHERE regexp_matches(word, '[0-9]'))"
adapters.SQL["marks"] = "marks AS MATERIALIZED (SELECT * FROM words WHERE contains(word, '@'))"


@query("""SELECT doc_id, line, pos, word FROM numbers ANTI JOIN (SELECT DISTINCT a.doc_id, a.line, a.pos FROM numbers AS a JOIN marks AS m ON a.doc_id = m.doc_id AND m.top <= a.top
    AND sqrt((a.x + a.width / 2 - m.x - m.width / 2) * (a.x + a.width / 2 - m.x - m.width / 2) + (a.top + a.height / 2 - m.top - m.height / 2) * (a.top + a.height / 2 - m.top - m.height / 2)) <= 220) USING (doc_id, line, pos)""", "words", "numbers", "marks")
def drained_anti(spark, d):
    return word_ops.without_above(*digits_and_marks(spark, d), 220).select("doc_id", "line", "pos", "word")


@query("""SELECT doc_id, line, pos, b_line, b_pos, ratio FROM (SELECT a.doc_id, a.line, a.pos, b.line AS b_line, b.pos AS b_pos,
    (least(a.x + a.width, b.bx + b.bwidth) - greatest(a.x, b.bx)) * (least(a.top + a.height, b.btop + b.height) - greatest(a.top, b.btop)) / least(a.width * a.height, b.bwidth * b.height) AS ratio
    FROM numbers AS a JOIN (SELECT *, x + 5 - 40 * (pos % 2) AS bx, top + 3 + 20 * (line % 2) AS btop, width * (1 + 6 * (pos % 3 = 0)::INT) AS bwidth FROM numbers) AS b
    ON a.doc_id = b.doc_id AND a.x < b.bx + b.bwidth AND b.bx < a.x + a.width AND a.top < b.btop + b.height AND b.btop < a.top + a.height) WHERE ratio >= 0.2""", "words", "numbers")
def word_overlap_pairs(spark, d):
    """Boxes of two passes; the second's are shifted, some to the next line, some very wide."""
    first = adapters.words(spark, d).filter(F.col("word").rlike("[0-9]"))
    wide = F.when(F.col("pos") % 3 == 0, 7).otherwise(1)
    return word_ops.overlapping(first, first.withColumns({"x": F.col("x") + 5 - 40 * (F.col("pos") % 2), "top": F.col("top") + 3 + 20 * (F.col("line") % 2), "width": F.col("width") * wide}))


@query("""SELECT id, k, greatest(0, k * c - e)::INT AS top, (least(h, least(h, (k + 1) * c) + e) - greatest(0, k * c - e))::INT AS height FROM (
    SELECT *, unnest(range(3)) AS k FROM (SELECT *, round_even(c * 0.18, 0) AS e FROM (SELECT o_orderkey AS id, 300 + o_orderkey % 1700 AS h, greatest(1, ceil((300 + o_orderkey % 1700) / 3)) AS c FROM orders)))""")
def tile_grid(spark, d):
    h = (300 + F.col("o_orderkey") % 1700).cast("int")
    grid = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(geometry.tiles(F.lit(1000), h)).alias("k", "tile"))
    return grid.select("id", F.col("k").cast("long").alias("k"), "tile.top", "tile.height")


def extracted(spark, d, name: str, pattern: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias(name)).groupBy("doc_id", name).agg(F.count(F.lit(1)).alias("n"))


def extract_sql(name: str, pattern: str) -> str:
    return f"SELECT doc_id, {name}, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS {name} FROM documents) GROUP BY ALL"


ASCII_EMAIL, ASCII_DATE, ASCII_PHONE, ASCII_QUANTITY = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+[.][A-Za-z]{2,}", "[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", "[+]?[0-9][0-9 -]{8,}[0-9]", "[0-9]+([.][0-9]+)?[ ]?(kg|g|ml|l)"


@query(extract_sql("email", ASCII_EMAIL))
def email_extract(spark, d):
    return extracted(spark, d, "email", ASCII_EMAIL)


@query(extract_sql("date", ASCII_DATE))
def date_extract(spark, d):
    return extracted(spark, d, "date", ASCII_DATE)


@query(extract_sql("phone", ASCII_PHONE))
def phone_extract(spark, d):
    return extracted(spark, d, "phone", ASCII_PHONE)


@query(extract_sql("quantity", ASCII_QUANTITY))
def quantity_extract(spark, d):
    return extracted(spark, d, "quantity", ASCII_QUANTITY)


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS cleaned FROM part")
def clean_text(spark, d):
    return table(spark, d, "part").select("p_partkey", text.clean(F.col("p_name")).alias("cleaned"))


TERMS = "terms(term) AS (VALUES " + ", ".join(f"('{t}')" for t in dims.VOCABULARY) + ")"
adapters.SQL["terms"] = TERMS


@query("SELECT doc_id, term, count(*) AS n FROM words JOIN terms ON regexp_replace(lower(word), '[^a-z]', '', 'g') = term GROUP BY ALL", "words", "terms")
def vocab_match(spark, d):
    w = adapters.words(spark, d).select("doc_id", F.regexp_replace(F.lower("word"), "[^a-z]", "").alias("term"))
    return w.join(F.broadcast(dims.vocabulary(spark).select("term")), "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query()
def fuzzy_vocab(spark, d):
    """Spellings near a commodity term: distinct tokens first, lengths within two, similarity 0.85 or more."""
    tokens = adapters.words(spark, d).select(F.regexp_replace(F.lower("word"), "[^a-z]", "").alias("token")).filter(F.length("token") >= 4).distinct()
    terms = dims.vocabulary(spark).withColumn("n", F.explode(F.sequence(F.length("term") - 2, F.length("term") + 2)))  # 46 x 5 rows
    near = tokens.withColumn("n", F.length("token")).join(F.broadcast(terms), "n").filter(F.levenshtein("token", "term") <= F.length("term"))
    return near.withColumn("ratio", text.similarity("token", "term")).filter("ratio >= 0.85").select("token", "term", "ratio")
