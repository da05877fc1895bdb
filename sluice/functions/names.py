"""Names of states, reasons and codes, and how they are grouped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lifecycle states, in declared order, and their accounting buckets.
LIFECYCLES = ("waiting", "ready", "scheduled", "dispatched", "running", "completion-reported", "completed", "cancelling", "cancelled", "preempting", "failed", "ambiguous")
TERMINAL = ("completed", "cancelled", "failed")
OPEN_WORK = ("dispatched", "running", "completion-reported", "cancelling", "preempting")
# Attempt states and the order in which gauges report them.
ATTEMPT_STATES = ("open", "started", "committed", "preempted", "cancelled", "abandoned", "rejected")
LIVE_ATTEMPTS = ("open", "started")
# Codes that say "try again later", and those that say "your authority is old".
TRANSIENT = ("not-ready", "not-released", "dependency-unsatisfied", "capacity-unavailable", "reservation-closed", "reservation-exhausted", "concurrency-limit", "preemption-throttled", "busy")
STALENESS = (
    "stale-flow-generation", "stale-path-generation", "stale-resource-generation", "stale-reservation-generation", "stale-policy-generation", "stale-qos-generation", "stale-priority-generation",
    "stale-schedule-generation", "stale-epoch", "stale-attempt", "stale-authority", "fenced", "completion-for-closed-attempt",
)
SIGNALS = {0: "none", 1: "ready", 2: "not-ready"}


def is_terminal(lifecycle: Column) -> Column:
    return lifecycle.isin(*TERMINAL)


def holds_open_work(lifecycle: Column) -> Column:
    return lifecycle.isin(*OPEN_WORK)


def bucket_of(lifecycle: Column) -> Column:
    """The accounting bucket of a lifecycle state."""
    return F.when(holds_open_work(lifecycle), "in-flight").otherwise(lifecycle)


def is_attempt_terminal(state: Column) -> Column:
    return ~state.isin(*LIVE_ATTEMPTS)


def error_class(code: Column) -> Column:
    """transient, stale or final."""
    return F.when(code.isin(*TRANSIENT), "transient").when(code.isin(*STALENESS), "stale").otherwise("final")
