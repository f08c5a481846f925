"""Review state machines as ordered folds of an event log.

Both give every event its outcome; the state and the audit trail of an id follow from its accepted events.  The
transitions that matter are decided by the first accepted event of a kind, so windows express the folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dims import STATUSES
from .reports import review_reasons


def blank(x: str) -> Column:
    return F.coalesce(F.trim(F.col(x)), F.lit("")) == ""


def durable(events: DataFrame, *order: str) -> DataFrame:
    """PENDING until the first valid PASS or VIOLATION; REVIEW keeps it pending.

    Events ``id, decision, inspector, reason``; checks in order: decision, identity, reason (not for REVIEW), still pending.
    Adds ``outcome`` (accepted or why not), ``action`` and ``state`` after the event.
    """
    why = (
        F.when(~F.col("decision").isin(*STATUSES), "invalid decision")
        .when(blank("inspector"), "missing identity")
        .when((F.col("decision") != "REVIEW") & blank("reason"), "missing reason")
    )
    by = Window.partitionBy("id").orderBy(*order)
    df = events.withColumn("_why", why).withColumn("_ends", (F.col("_why").isNull() & (F.col("decision") != "REVIEW")).cast("int"))
    df = df.withColumn("_ended", F.coalesce(F.sum("_ends").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)
    outcome = F.coalesce("_why", F.when(F.col("_ended"), "not pending"), F.lit("accepted"))
    df = df.withColumn("outcome", outcome)
    action = F.when(F.col("outcome") == "accepted", F.when(F.col("decision") == "REVIEW", "retain_review").otherwise("resolve"))
    state = F.when(F.col("_ended") | ((F.col("outcome") == "accepted") & (F.col("decision") != "REVIEW")), "RESOLVED").otherwise("PENDING")
    return df.withColumn("action", action).withColumn("state", state).drop("_why", "_ends", "_ended")


def resolutions(folded: DataFrame, *order: str) -> DataFrame:
    """The state of each id: its resolving event, if any."""
    first = F.min(F.when(F.col("action") == "resolve", F.struct(*order, "decision", "inspector")))
    out = folded.groupBy("id").agg(first.alias("r"), F.count_if(F.col("outcome") == "accepted").alias("n_audit"), F.count_if(F.col("outcome") != "accepted").alias("n_rejected"))
    return out.select("id", F.when(F.col("r").isNull(), "PENDING").otherwise("RESOLVED").alias("state"), F.col("r.decision").alias("final_decision"), F.col("r.inspector").alias("inspector"), "n_audit", "n_rejected")


def audit_trail(folded: DataFrame, *order: str) -> DataFrame:
    """Accepted events of each id in order."""
    own = folded.filter("outcome = 'accepted'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*order, "action", "decision", "inspector"))).alias("trail"))
    return own.select("id", F.transform("trail", lambda e: F.struct(e["action"].alias("action"), e["decision"].alias("decision"), e["inspector"].alias("inspector"))).alias("trail"))


def session(events: DataFrame, *order: str) -> DataFrame:
    """PENDING to CONFIRMED or OVERRIDDEN; confirming again changes nothing, crossing or overriding again is an error.

    Events ``id, action (create, confirm, override), system_status, inspector, reason``.  Only REVIEW is created; confirm checks
    the identity, override the reason before the identity.
    """
    by = Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("action") == "create") & (F.upper(F.trim("system_status")) == "REVIEW")
    why = (
        F.when((F.col("action") == "create") & ~F.coalesce(fresh, F.lit(False)), "not created")
        .when((F.col("action") == "override") & blank("reason"), "missing reason")
        .when(F.col("action").isin("confirm", "override") & blank("inspector"), "missing identity")
    )
    df = events.withColumn("_why", why)
    df = df.withColumn("_made", F.coalesce(F.max((fresh & F.col("_why").isNull()).cast("int")).over(by), F.lit(0)))
    closes = F.when(F.col("_why").isNull() & (F.col("_made") == 1) & F.col("action").isin("confirm", "override"), F.col("action"))
    df = df.withColumn("_close", closes).withColumn("_closed", F.first("_close", ignorenulls=True).over(by))
    outcome = (
        F.when(F.col("_why").isNotNull(), F.col("_why"))
        .when((F.col("action") == "create") & (F.col("_made") == 1), "duplicate")
        .when((F.col("action") != "create") & (F.col("_made") == 0), "unknown review")
        .when((F.col("_closed") == "confirm") & (F.col("action") == "confirm"), "unchanged")
        .when(F.col("_closed").isNotNull() & (F.col("action") != "create"), "already completed")
        .otherwise("accepted")
    )
    df = df.withColumn("outcome", outcome)
    closed = F.coalesce("_closed", F.when(F.col("outcome") == "accepted", F.col("_close")))
    state = F.when(closed == "confirm", "CONFIRMED").when(closed == "override", "OVERRIDDEN").when((F.col("_made") == 1) | (F.col("outcome") == "accepted"), "PENDING")
    return df.withColumn("state", state).drop("_why", "_made", "_close", "_closed")


def close_out(durable_events: DataFrame, session_events: DataFrame, *order: str) -> DataFrame:
    """Both machines over one order of events: resolving a durable review confirms the session review of its id, if that is pending.

    Events as ``durable`` and ``session`` take them.  Gives ``id``, order, ``machine`` (durable, session, or closing: a derived
    confirmation, only where it has an effect), ``action``, ``outcome`` and ``state``.
    """
    folded = durable(durable_events, *order)
    closing = folded.filter("action = 'resolve'").select("id", *order, F.lit("confirm").alias("action"), F.lit(None).cast("string").alias("system_status"), "inspector", "reason", F.lit("closing").alias("machine"))
    own = session_events.select("id", *order, "action", "system_status", "inspector", "reason", F.lit("session").alias("machine"))
    # of the same place in the order, the session's own event comes second
    sessions = session(own.unionByName(closing), *order, "machine").filter("machine = 'session' or outcome = 'accepted'")
    shown = ["id", *order, "machine", "action", "outcome", "state"]
    return folded.withColumn("machine", F.lit("durable")).select(*shown).unionByName(sessions.select(*shown))


#: What is said of reviews that are open, complete, or not there.
OPEN_NOTICE = "AI output is not a final legal decision until inspector verification"
DONE_NOTICE = "Inspector verification recorded; original automated decision is preserved"


def responses(asked: DataFrame, reviews: DataFrame) -> DataFrame:
    """A row for every asked ``id``: its review ``state``, what it is worth, and a placeholder where there is none."""
    found, done = F.col("state").isNotNull(), F.coalesce(F.col("state").isin("CONFIRMED", "OVERRIDDEN"), F.lit(False))
    marks = {"found": found, "is_final_legal_decision": done, "decision_support_only": ~done, "legal_notice": F.when(done, DONE_NOTICE).otherwise(OPEN_NOTICE)}
    return asked.join(reviews, "id", "left").withColumns(marks).withColumnRenamed("state", "inspector_decision")


def pending_rows(reports: DataFrame) -> DataFrame:
    """Reports under review with ``reasons`` (field -> reason) of the fields that are, from ``decisions`` (field -> status and reason)."""
    return reports.filter("overall_result = 'REVIEW'").withColumn("reasons", review_reasons(F.col("decisions"))).drop("decisions")
