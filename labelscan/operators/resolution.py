"""Resolving reviews: decision, report and audit trail change in one commit.

Tables of the store: ``reports`` (id, overall_result, reviewer_status and more), ``decisions`` (id, review_status,
inspector_decision, inspector, reviewer, reason, final_decision), ``audit`` (one row for each accepted event).  The audit trail is a table,
not an array of the decision, so an id with very many events stays no burden to its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import STATUSES
from ..sources.versions import Versions
from .reports import review_reasons

KEYS = {"reports": ["id"], "decisions": ["id"], "audit": []}


def text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def pending(reports: DataFrame) -> DataFrame:
    """The first decision row of every report under review; ``field_decisions`` (field -> status and reason), if there, gives its reasons."""
    reasons = review_reasons(F.col("field_decisions")) if "field_decisions" in reports.columns else F.lit(None).cast("map<string,string>")
    empty = [F.lit(None).cast("string").alias(c) for c in ("inspector_decision", "inspector", "reviewer", "reason")]
    return reports.filter("overall_result = 'REVIEW'").select("id", F.lit("REVIEW").alias("automated_decision"), reasons.alias("automated_reasons"), F.lit("PENDING").alias("review_status"), *empty, F.lit("REVIEW").alias("final_decision"))


def judged(events: DataFrame, decisions: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``outcome`` to events ``id, decision, inspector, reviewer, reason``: accepted, or the first check that fails.

    ``order`` is total within an id.  The first valid PASS or VIOLATION of a pending id ends it; finding it is an aggregation by id,
    so no window runs over an id's events.  Decisions and ends grow with the reports, so both are joined by shuffles: narrow columns in a
    compressed file look small enough to broadcast when they aren't.
    """
    why = (
        F.when(~F.col("decision").isin(*STATUSES), "invalid decision")
        .when((F.col("inspector") == "") | (F.col("reviewer") == ""), "missing identity")
        .when((F.col("decision") != "REVIEW") & (F.col("reason") == ""), "missing reason")
    )
    clean = events.withColumns({"decision": F.upper(text("decision"))} | {c: text(c) for c in ("inspector", "reviewer", "reason")})
    known = clean.withColumn("_why", why).join(decisions.select("id", F.col("review_status").alias("_status")).hint("merge"), "id", "left")
    at = F.struct(*order)
    ends = known.filter("_why is null and _status = 'PENDING' and decision <> 'REVIEW'").groupBy("id").agg(F.min(at).alias("_end"))
    over = (F.col("_status") != "PENDING") | F.coalesce(at > F.col("_end"), F.lit(False))
    outcome = F.coalesce("_why", F.when(F.col("_status").isNull(), "review not found").when(over, "already resolved"), F.lit("accepted"))
    return known.join(ends.hint("merge"), "id", "left").withColumn("outcome", outcome).drop("_why", "_status", "_end")


def changes(events: DataFrame, reports: DataFrame, decisions: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """What the events change, by table; REVIEW keeps an id pending, with who looked at it."""
    accepted = judged(events, decisions, order).filter("outcome = 'accepted'")
    said = ["decision", "inspector", "reviewer", "reason"]
    last = accepted.groupBy("id").agg(F.max_by(F.struct(*said), F.struct(*order)).alias("said"))
    open_ = F.col("said.decision") == "REVIEW"
    status = F.when(open_, "PENDING").otherwise("RESOLVED")
    new = {"review_status": status, "inspector_decision": F.when(~open_, F.col("said.decision")), "final_decision": F.col("said.decision")} | {c: F.col(f"said.{c}") for c in said[1:]}
    put = lambda df, columns: df.join(last.hint("merge"), "id").withColumns(columns).select(*df.columns)
    action = F.when(F.col("decision") == "REVIEW", "retain_review").otherwise("resolve")
    return {
        "reports": put(reports, {"overall_result": F.col("said.decision"), "reviewer_status": status}),
        "decisions": put(decisions, new),
        "audit": accepted.select("id", *order, action.alias("action"), *said),
    }


def open_store(store: Versions, reports: DataFrame, audit: DataFrame) -> int:
    """The first version: reports, their pending decisions, an empty audit table like ``audit``."""
    return store.create(KEYS, reports=reports.withColumn("reviewer_status", F.lit(None).cast("string")), decisions=pending(reports), audit=audit.limit(0))


def resolve(store: Versions, events: DataFrame, order: list[str]) -> int:
    """Applies events to the newest version: all three tables change, or none does."""
    manifest = store.manifest()
    return store.commit(manifest, **changes(events, store.read("reports", manifest), store.read("decisions", manifest), order))


def decision_of(store: Versions, ident) -> DataFrame:
    """The decision of one id with its audit trail, no row if there is none."""
    trail = store.read("audit").filter(F.col("id") == ident)
    order = trail.columns[1 : trail.columns.index("action")]
    rows = trail.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*trail.columns[1:]))).alias("trail"))
    out = store.read("decisions").filter(F.col("id") == ident).join(rows, "id", "left")
    drop = lambda e: F.struct(*[e[c].alias(c) for c in trail.columns[1:] if c not in order])
    return out.withColumn("trail", F.coalesce(F.transform("trail", drop), F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in trail.columns[1 + len(order):])}>>")))
