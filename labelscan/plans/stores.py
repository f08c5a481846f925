"""Queries of the operators that keep stores: resolution of reviews and its commits, close-out, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolution, review
from ..sources import adapters, layout
from ..sources.readers import table
from ..sources.registry import Registry
from ..sources.versions import Versions, shared_folder
from .catalogue import query

#: Events of reviews, three to an inspection, that come in two deliveries.
ASKED = """asked_events AS (
    SELECT event_id // 3 AS id, event_id, event_id % 2 AS delivery, CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'error' THEN ' violation ' WHEN 'click' THEN 'REVIEW' WHEN 'view' THEN 'PASS' ELSE 'unsure' END AS decision,
           CASE WHEN event_id % 11 > 0 THEN 'inspector-' || event_id % 7 END AS inspector, CASE WHEN event_id % 13 > 0 THEN 'name' ELSE ' ' END AS reviewer, CASE WHEN user_id % 5 > 0 THEN props END AS reason FROM events
    ), tested AS (
        SELECT * REPLACE (upper(trim(decision)) AS decision), upper(trim(decision)) IN ('PASS', 'VIOLATION', 'REVIEW') AND inspector IS NOT NULL AND reviewer = 'name'
               AND (upper(trim(decision)) = 'REVIEW' OR reason IS NOT NULL) AS valid FROM asked_events JOIN (SELECT id FROM inspections WHERE overall_result = 'REVIEW') USING (id)
    ), accepted AS (
        SELECT * FROM (SELECT *, coalesce(bool_or(valid AND decision <> 'REVIEW') OVER (PARTITION BY id ORDER BY delivery, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM tested) WHERE valid AND NOT done
    ), final AS (SELECT id, arg_max(decision, (delivery, event_id)) AS decision, arg_max(inspector, (delivery, event_id)) AS inspector, count(*) AS n_audit FROM accepted GROUP BY id)"""
adapters.SQL["asked_events"] = ASKED


def asked_events(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    decision = F.when(kind.isin("purchase", "view"), "PASS").when(kind == "error", " violation ").when(kind == "click", "REVIEW").otherwise("unsure")
    return table(spark, d, "events").select(
        F.expr("event_id div 3").alias("id"), "event_id", (k % 2).alias("delivery"), decision.alias("decision"), F.when(k % 11 > 0, F.concat(F.lit("inspector-"), (k % 7).cast("string"))).alias("inspector"),
        F.when(k % 13 > 0, "name").otherwise(" ").alias("reviewer"), F.when(F.col("user_id") % 5 > 0, F.col("props")).alias("reason"),
    )


def resolved_store(spark, d) -> Versions:
    """Reports of the tables, their pending reviews, and two deliveries of events, each applied in one commit."""
    store, events = Versions(spark, shared_folder(spark, "reviews")), asked_events(spark, d)
    order = ["delivery", "event_id"]
    audit = events.select("id", *order, F.lit("").alias("action"), "decision", "inspector", "reviewer", "reason")
    resolution.open_store(store, adapters.inspections(spark, d, "merge").select("id", "filename", "created_at", "overall_result"), audit)
    for delivery in (0, 1):
        resolution.resolve(store, events.filter(F.col("delivery") == delivery), order)
    return store


@query("""SELECT i.id, coalesce(decision, overall_result) AS overall_result, CASE WHEN decision = 'REVIEW' THEN 'PENDING' WHEN decision IS NOT NULL THEN 'RESOLVED' END AS reviewer_status,
    CASE WHEN overall_result = 'REVIEW' THEN CASE WHEN coalesce(decision, 'REVIEW') = 'REVIEW' THEN 'PENDING' ELSE 'RESOLVED' END END AS review_status, CASE WHEN overall_result = 'REVIEW' THEN coalesce(decision, 'REVIEW') END AS final_decision,
    nullif(decision, 'REVIEW') AS inspector_decision, inspector, coalesce(n_audit, 0) AS n_audit FROM inspections AS i LEFT JOIN final USING (id)""", "inspections", "asked_events")
def resolved_reports(spark, d):
    """Reports, decisions and audit trails after both commits."""
    store = resolved_store(spark, d)
    trail = store.read("audit").groupBy("id").agg(F.count(F.lit(1)).alias("n_audit"))
    out = store.read("reports").join(store.read("decisions").drop("reason").hint("merge"), "id", "left").join(trail.hint("merge"), "id", "left")
    return out.select("id", "overall_result", "reviewer_status", "review_status", "final_decision", "inspector_decision", "inspector", F.coalesce("n_audit", F.lit(0)).alias("n_audit"))


@query("SELECT id, event_id, CASE WHEN decision = 'REVIEW' THEN 'retain_review' ELSE 'resolve' END AS action, decision, inspector, reason FROM accepted", "inspections", "asked_events")
def audit_events(spark, d):
    rows = resolved_store(spark, d).read("audit")
    return rows.select("id", "event_id", "action", "decision", "inspector", F.nullif("reason", F.lit("")).alias("reason"))


@query("""SELECT event_id, CASE WHEN upper(trim(decision)) NOT IN ('PASS', 'VIOLATION', 'REVIEW') THEN 'invalid decision' WHEN inspector IS NULL OR reviewer = ' ' THEN 'missing identity'
    WHEN upper(trim(decision)) <> 'REVIEW' AND reason IS NULL THEN 'missing reason' WHEN id NOT IN (SELECT id FROM tested) THEN 'review not found'
    WHEN event_id IN (SELECT event_id FROM accepted) THEN 'accepted' ELSE 'already resolved' END AS outcome FROM asked_events""", "inspections", "asked_events")
def judged_events(spark, d):
    """What becomes of each event, with the reason why."""
    decisions = resolution.pending(adapters.inspections(spark, d, "merge"))
    return resolution.judged(asked_events(spark, d), decisions, ["delivery", "event_id"]).select("event_id", "outcome")


# -- both review machines over one order of events --------------------------------------------------------------------



def machine_events(spark, d):
    """Durable events (views and purchases decide) and session events (the others create, confirm and override), 4 ids to a user."""
    k, kind = F.col("event_id"), F.col("event_type")
    base = table(spark, d, "events").withColumn("id", F.col("user_id") * 40 + k % 40).withColumn("inspector", F.when(k % 7 > 0, F.lit("inspector")))
    decision = F.when(kind == "view", "REVIEW").when(k % 2 == 0, "PASS").otherwise("VIOLATION")
    durable = base.filter(kind.isin("view", "purchase")).select("id", "event_id", decision.alias("decision"), "inspector", "props")
    action = F.when(kind == "signup", "create").when(kind == "error", "override").otherwise("confirm")
    session = base.filter(~kind.isin("view", "purchase")).select("id", "event_id", action.alias("action"), F.when(kind == "signup", " review").alias("system_status"), "inspector", F.when(k % 3 > 0, F.col("props")).alias("reason"))
    return durable.withColumnRenamed("props", "reason"), session


@query("""WITH base AS (SELECT user_id * 40 + event_id % 40 AS id, event_id, event_type, CASE WHEN event_id % 7 > 0 THEN 'inspector' END AS inspector, props FROM events),
    durable AS (SELECT id, event_id, CASE WHEN event_type = 'view' THEN 'REVIEW' WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'VIOLATION' END AS decision, inspector IS NOT NULL AS valid FROM base WHERE event_type IN ('view', 'purchase')),
    ended AS (SELECT id, min(event_id) AS ends FROM durable WHERE valid AND decision <> 'REVIEW' GROUP BY id),
    moves AS (SELECT id, event_id, 1 AS second, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'override' ELSE 'confirm' END AS action,
                     CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'missing reason' WHEN event_type <> 'signup' AND inspector IS NULL THEN 'missing identity' END AS why FROM base WHERE event_type NOT IN ('view', 'purchase')
              UNION ALL SELECT id, ends, 0, 'confirm', NULL FROM ended),
    opened AS (SELECT *, coalesce(bool_or(action = 'create') OVER w, false) AS made FROM moves WINDOW w AS (PARTITION BY id ORDER BY event_id, second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    closed AS (SELECT *, first_value(CASE WHEN why IS NULL AND made AND action <> 'create' THEN action END IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id, second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM opened),
    told AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN action = 'create' THEN CASE WHEN made THEN 'duplicate' ELSE 'accepted' END WHEN NOT made THEN 'unknown review' WHEN done = 'confirm' AND action = 'confirm' THEN 'unchanged'
             WHEN done IS NOT NULL THEN 'already completed' ELSE 'accepted' END AS outcome FROM closed)
    SELECT id, event_id, 'durable' AS machine, CASE WHEN valid AND NOT coalesce(event_id > ends, false) THEN CASE WHEN decision = 'REVIEW' THEN 'retain_review' ELSE 'resolve' END END AS action,
           CASE WHEN NOT valid THEN 'missing identity' WHEN event_id > ends THEN 'not pending' ELSE 'accepted' END AS outcome, CASE WHEN event_id >= ends THEN 'RESOLVED' ELSE 'PENDING' END AS state FROM durable LEFT JOIN ended USING (id)
    UNION ALL SELECT id, event_id, CASE second WHEN 1 THEN 'session' ELSE 'closing' END, action, outcome, CASE coalesce(done, CASE WHEN outcome = 'accepted' AND action <> 'create' THEN action END) WHEN 'confirm' THEN 'CONFIRMED' WHEN 'override' THEN 'OVERRIDDEN'
           ELSE CASE WHEN made OR outcome = 'accepted' THEN 'PENDING' END END FROM told WHERE second = 1 OR outcome = 'accepted'""")
def review_close_out(spark, d):
    """Every event of both machines and the confirmations that durable resolutions cause."""
    return review.close_out(*machine_events(spark, d), "event_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'CONFIRMED' WHEN p_partkey % 3 = 1 THEN 'PENDING' END AS inspector_decision, p_partkey % 3 < 2 AS found, p_partkey % 3 = 0 AS is_final_legal_decision, p_partkey % 3 <> 0 AS decision_support_only,
    CASE WHEN p_partkey % 3 = 0 THEN 'Inspector verification recorded; original automated decision is preserved' ELSE 'AI output is not a final legal decision until inspector verification' END AS legal_notice FROM part""")
def review_responses(spark, d):
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    reviews = asked.filter("id % 3 < 2").withColumn("state", F.when(F.col("id") % 3 == 0, "CONFIRMED").otherwise("PENDING"))
    return review.responses(asked, reviews)


# -- lookups and schemas of all ages ----------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderpriority AS filename, 'PENDING' AS review_status FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (3, 34, 335, 1401)")
def decision_lookup(spark, d):
    """Pending decisions laid out for lookups, and four lookups of one key each."""
    folder = shared_folder(spark, "decisions")
    pending = resolution.pending(adapters.inspections(spark, d)).select("id", "review_status")
    layout.write_for_lookup(pending.join(adapters.inspections(spark, d).select("id", "filename").hint("merge"), "id"), folder, "id", 16)
    found = [layout.lookup(spark, folder, "id", k, 16) for k in (3, 34, 335, 1401)]
    return reduce(DataFrame.union, found).select("id", "filename", "review_status")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS product, CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END ELSE 'NONE' END AS reviewer_status FROM orders""")
def evolved_log(spark, d):
    """Rows of three versions of a schema: a column comes, is renamed, another comes with a default."""
    log, k = Registry(spark, shared_folder(spark, "log")), F.col("id")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus")
    log.create("id long")
    log.append(rows.filter(k % 3 == 0).select("id"))
    log.add("product_name", "string")
    log.append(rows.filter(k % 3 == 1).select("id", F.col("o_orderpriority").alias("product_name")))
    log.rename("product_name", "product")
    log.add("reviewer_status", "string", "'NONE'")
    log.append(rows.filter(k % 3 == 2).select("id", F.col("o_orderpriority").alias("product"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("reviewer_status")))
    return log.read()
