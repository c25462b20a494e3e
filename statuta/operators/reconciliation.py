"""Reconciliation of references that point to other documents: a state machine over the history of each bundle.

A history is rows of two kinds, by run.  ``resolve`` says what the bundle's mention now stands for; ``attempt`` says what came of writing it.  What
has been committed once is never silently changed: if the targets differ later, the bundle is blocked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.streaming.folds import Machine, fold, fold_stream

# Fixed codes of states and reasons.
NOT_APPLICABLE, PENDING, WRITTEN, FAILED, BLOCKED = STATES = ("NOT_APPLICABLE", "PENDING", "WRITTEN", "FAILED", "BLOCKED")
CHANGED = "resolved_target_changed_after_materialization"
BLOCKING = {"bundle_target_conflict_in_graph": CHANGED, "partial_materialized_bundle_in_graph": None, "endpoint_document_ownership_ambiguous_in_graph": None}


def _resolved(state: dict | None, row: dict) -> dict:
    """The state after a new resolution: kept if the targets are the same, blocked if others were written, else as new."""
    targets = sorted(row.get("targets") or [])
    wanted = row.get("resolution") == "RESOLVED" and bool(row.get("external"))
    reason = "self_reference_no_edge" if row.get("self_reference") else "local_reference_not_external" if row.get("resolution") == "RESOLVED" and not row.get("external") else None
    new = {"status": PENDING if wanted else NOT_APPLICABLE, "reason": reason}
    if state is not None:
        if state["targets"] == targets:
            new = {"status": state["status"], "reason": state["reason"]}
        elif state["committed"] or state["status"] in (WRITTEN, BLOCKED):
            new = {"status": BLOCKED, "reason": CHANGED}
    return new | {"targets": targets, "wanted": wanted, "committed": state["committed"] if state else [], "attempts": state["attempts"] if state else 0}


def _attempted(state: dict, row: dict) -> dict:
    """The state after an attempt to write; what is written or blocked, or never was to be written, stays."""
    if not state["wanted"] or state["status"] in (WRITTEN, BLOCKED):
        return state
    if state["committed"] and state["targets"] not in state["committed"]:
        return state | {"status": BLOCKED, "reason": CHANGED}
    if not row.get("valid"):
        return state | {"status": FAILED, "reason": "external_reference_validation_failed"}
    tried, error = state | {"attempts": state["attempts"] + 1}, row.get("error")
    if row.get("outcome") == "COMMITTED":
        committed = state["committed"] if state["targets"] in state["committed"] else [*state["committed"], state["targets"]]
        return tried | {"status": WRITTEN, "reason": None, "committed": committed}
    if error in BLOCKING:
        return tried | {"status": BLOCKED, "reason": BLOCKING[error] or error}
    return tried | {"status": FAILED, "reason": error or "materialization_failed"}


def step(state: dict | None, row: dict) -> tuple[dict | None, list[tuple]]:
    """One row of a history; a run that isn't later than the last one taken, or an attempt before any resolution, changes nothing."""
    run = row.get("run")
    late = run is None or (state is not None and run <= state["run"]) or (state is None and row.get("kind") != "resolve")
    if not late:
        state = (_resolved(state, row) if row.get("kind") == "resolve" else _attempted(state, row)) | {"run": run}
    told = state or {"status": None, "reason": None, "attempts": 0, "committed": []}
    return state, [(row.get("seq"), not late, told["status"], told["reason"], told["attempts"], len(told["committed"]))]


MACHINE = Machine(step, "seq long, applied boolean, status string, reason string, attempts long, n_committed long")


def reconciled(history: DataFrame, key: str = "bundle_id", order: str = "seq") -> DataFrame:
    """``bundle_id, seq, applied, status, reason, attempts, n_committed`` after each row of a history.

    ``history`` has the bundle, ``seq``, ``run``, ``kind`` (resolve or attempt), ``resolution, external, self_reference, targets`` of a resolution, and
    ``valid, outcome, error`` of an attempt.
    """
    return fold(history, MACHINE, key, order)


def reconciled_stream(history: DataFrame, key: str = "bundle_id", order: str = "seq") -> DataFrame:
    """As ``reconciled`` over a stream; rows that come late are told by their run and change nothing."""
    return fold_stream(history, MACHINE, key, order)


def latest(trace: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Each bundle's last state."""
    last = F.max_by(F.struct("status", "reason", "attempts", "n_committed"), "seq").alias("s")
    return trace.groupBy(key).agg(last).select(key, "s.*")


def counts(states: DataFrame) -> DataFrame:
    """``total`` and a count for each state."""
    return states.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATES])
