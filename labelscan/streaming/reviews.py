"""Both review machines on one stream: a durable resolution closes the session review of its id.

Events of two kinds arrive in one stream, keyed by id, so the state of both machines lies together and an
event of one can move the other.  State that nobody has touched for the time to live is dropped, so it doesn't grow for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.dims import STATUSES

MOVED = "id long, event_id long, machine string, action string, outcome string, state string"
EVENTS = ["id", "event_id", "machine", "action", "decision", "system_status", "inspector", "reason"]
DAYS = 24 * 3600 * 1000


def events_of(durable: DataFrame, session: DataFrame) -> DataFrame:
    """One stream of durable events (``decision``) and session events (``action``, ``system_status``)."""
    none = F.lit(None).cast("string")
    own = durable.withColumns({"machine": F.lit("durable"), "action": none, "system_status": none})
    return own.select(*EVENTS).unionByName(session.withColumns({"machine": F.lit("session"), "decision": none}).select(*EVENTS))


def clean(x) -> str:
    return "" if pd.isna(x) else str(x).strip()


def durable_step(e, resolved: bool) -> tuple[str, str | None]:
    """(outcome, action) of a durable event; checks in order: decision, identity, reason, still pending."""
    if e.decision not in STATUSES:
        return "invalid decision", None
    if not clean(e.inspector):
        return "missing identity", None
    if e.decision != "REVIEW" and not clean(e.reason):
        return "missing reason", None
    if resolved:
        return "not pending", None
    return "accepted", "retain_review" if e.decision == "REVIEW" else "resolve"


def session_step(action: str, system_status: str, inspector: str, reason: str, state: str | None) -> tuple[str, str | None]:
    """(outcome, state after) of a session event."""
    if action == "create":
        if system_status.upper() != "REVIEW":
            return "not created", state
        return ("duplicate", state) if state else ("accepted", "PENDING")
    if action == "override" and not reason:
        return "missing reason", state
    if not inspector:
        return "missing identity", state
    if state is None:
        return "unknown review", state
    if state == "CONFIRMED" and action == "confirm":
        return "unchanged", state
    if state != "PENDING":
        return "already completed", state
    return "accepted", "CONFIRMED" if action == "confirm" else "OVERRIDDEN"


class Machines(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.held = handle.getValueState("machines", "resolved boolean, session string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        resolved, session = self.held.get() if self.held.exists() else (False, None)
        out = []
        for e in pd.concat(list(rows)).sort_values(["event_id", "machine"]).itertuples():
            if e.machine == "session":
                outcome, session = session_step(e.action, clean(e.system_status), clean(e.inspector), clean(e.reason), session)
                out.append((key[0], e.event_id, "session", e.action, outcome, session))
                continue
            outcome, action = durable_step(e, resolved)
            resolved = resolved or action == "resolve"
            out.append((key[0], e.event_id, "durable", action, outcome, "RESOLVED" if resolved else "PENDING"))
            if action == "resolve" and session == "PENDING":
                session = "CONFIRMED"
                out.append((key[0], e.event_id, "closing", "confirm", "accepted", session))
        self.held.update((resolved, session))
        yield pd.DataFrame(out, columns=["id", "event_id", "machine", "action", "outcome", "state"])

    def close(self) -> None:
        pass


def reviews(events: DataFrame, ttl: int = 90 * DAYS) -> DataFrame:
    """What becomes of every event of the stream ``events_of``; events of a micro-batch are taken in the order of ``event_id``.

    Needs the RocksDB state store.  An id that nobody has touched for ``ttl`` milliseconds starts anew.
    """
    return events.groupBy("id").transformWithStateInPandas(Machines(ttl), MOVED, "Append", "ProcessingTime")
