"""Changes of flows' state, each a projection over state joined with requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.names import is_terminal
from sluice.functions.scalars import first_match
from sluice.policy import Policy

c = F.col


def _named(state: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(state.select("flow_id", "generation", "lifecycle", "readiness_signal", "open_attempt", "wait_ticks", "eligible_since_tick", "last_change_tick"), "flow_id", "left")


def _stale() -> list[tuple[Column, str]]:
    return [(c("generation").isNull(), "unknown-flow"), (c("generation") != c("request_generation"), "stale-flow-generation")]


def wait_after(now: int) -> Column:
    """Ticks waited so far by a flow that leaves Ready at now."""
    return c("wait_ticks") + F.when(c("lifecycle") == "ready", F.greatest(F.lit(now) - c("eligible_since_tick"), F.lit(0))).otherwise(F.lit(0))


def cancel(state: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """(flow_id, status, lifecycle, closes_attempt, releases_window, wait_ticks) of cancellations (flow_id, request_generation); a cancelled flow may be cancelled again."""
    again = c("lifecycle") == "cancelled"
    status = first_match([*_stale(), (again, "ok"), (is_terminal(c("lifecycle")), "invalid-state")], "ok")
    rows = _named(state, requests).withColumn("status", status).withColumn("_acts", F.coalesce((c("status") == "ok") & ~again, F.lit(False)))
    return rows.select(
        "flow_id",
        "request_generation",
        "status",
        F.when(c("_acts"), "cancelled").otherwise(c("lifecycle")).alias("lifecycle"),
        (c("_acts") & c("open_attempt").isNotNull()).alias("closes_attempt"),
        (c("_acts") & (c("lifecycle") == "scheduled")).alias("releases_window"),
        F.when(c("_acts"), wait_after(now)).otherwise(c("wait_ticks")).alias("wait_ticks"),
    )


def signal_readiness(state: DataFrame, requests: DataFrame) -> DataFrame:
    """(flow_id, status, readiness_signal, changed) of signals (sequence, flow_id, request_generation, signal); the last of a flow wins."""
    latest = requests.withColumn("_rank", F.row_number().over(Window.partitionBy("flow_id").orderBy(c("sequence").desc()))).filter(c("_rank") == 1).drop("_rank")
    status = first_match([*_stale(), (is_terminal(c("lifecycle")), "invalid-state")], "ok")
    rows = _named(state, latest).withColumn("status", status)
    ok = c("status") == "ok"
    return rows.select("flow_id", "status", F.when(ok, c("signal")).otherwise(c("readiness_signal")).alias("readiness_signal"), F.coalesce(ok & (c("signal") != c("readiness_signal")), F.lit(False)).alias("changed"))


def resolve_ambiguous(state: DataFrame, requests: DataFrame) -> DataFrame:
    """(flow_id, status, lifecycle) of resolutions (flow_id, request_generation, resolution): retry waits again, abandon fails."""
    status = first_match([*_stale(), (c("lifecycle") != "ambiguous", "invalid-state")], "ok")
    rows = _named(state, requests).withColumn("status", status)
    after = F.when(c("status") == "ok", F.when(c("resolution") == "retry", "waiting").otherwise("failed")).otherwise(c("lifecycle"))
    return rows.select("flow_id", "status", after.alias("lifecycle"))


def advance_epoch(state: DataFrame) -> DataFrame:
    """(flow_id, lifecycle, open_attempt, outstanding_reserved) after an epoch advance: open attempts are abandoned and leave their flows ambiguous, windows are released."""
    after = first_match([(c("open_attempt").isNotNull(), "ambiguous"), (c("lifecycle") == "scheduled", "ready")], c("lifecycle"))
    return state.select("flow_id", after.alias("lifecycle"), F.lit(None).cast("long").alias("open_attempt"), F.lit(0).cast("long").alias("outstanding_reserved"))


def normalize(lifecycle: Column) -> Column:
    """A state at rest: preempting is ready, cancelling is cancelled."""
    return first_match([(lifecycle == "preempting", "ready"), (lifecycle == "cancelling", "cancelled")], lifecycle)


def reclaim(state: DataFrame, entries: DataFrame, policy: Policy, now: int) -> DataFrame:
    """(schedule_id, flow_id) of entries not dispatched within the delivery horizon."""
    due = entries.filter((c("kind") == "run") & (c("consumed") == 0) & (c("at_tick") + policy.dispatch_delivery_horizon <= now))
    return due.join(state.filter(c("lifecycle") == "scheduled").select("flow_id", "scheduled_schedule"), "flow_id").filter(c("scheduled_schedule") == c("schedule_id")).select("schedule_id", "flow_id")


def overdue(state: DataFrame, now: int) -> DataFrame:
    """(flow_id, open_attempt, newly_missed) of flows in flight at or past their deadline, whatever the preemption mode."""
    return state.filter(c("open_attempt").isNotNull() & (c("deadline_tick") <= now)).select("flow_id", "open_attempt", (~c("deadline_missed_counted")).alias("newly_missed"))


def apply_schedule(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What issuing run entries charges: (resource_id, in_flight, reserved) and (reservation_id, reserved)."""
    run = entries.filter(c("kind") == "run")
    by_resource = run.groupBy("resource_id").agg(F.count("flow_id").alias("in_flight"), F.sum("quantum").alias("reserved"))
    by_reservation = run.filter(c("reservation_id").isNotNull()).groupBy("reservation_id").agg(F.sum("quantum").alias("reserved"))
    return by_resource, by_reservation


def release(entries: DataFrame, state: DataFrame) -> DataFrame:
    """(schedule_id, released, still_charged) of schedules released: windows not yet dispatched go back, what they charged does not."""
    rows = entries.filter((c("kind") == "run") & (c("consumed") == 0)).join(state.filter(c("lifecycle") == "scheduled").select("flow_id"), "flow_id", "left_semi")
    return rows.groupBy("schedule_id").agg(F.count("flow_id").alias("released"), F.sum("quantum").alias("still_charged"))


def retained(schedules: DataFrame, keep: int) -> DataFrame:
    """schedules (position, open) with kept: beyond the newest keep ones the oldest go, up to the first that still holds authority."""
    newest = schedules.select("position").orderBy(c("position").desc()).limit(keep).agg(F.min("position").alias("_newest")).withColumn("_k", F.lit(0))
    open_ = schedules.filter("open").agg(F.min("position").alias("_open")).withColumn("_k", F.lit(0))
    rows = schedules.withColumn("_k", F.lit(0)).join(F.broadcast(newest), "_k").join(F.broadcast(open_), "_k")  # one row each
    return rows.withColumn("kept", (c("position") >= c("_newest")) | F.coalesce(c("position") >= c("_open"), F.lit(False))).select(*schedules.columns, "kept")


def retained_attempts(attempts: DataFrame, schedules: DataFrame) -> DataFrame:
    """The attempts of schedules (position, kept) that are not dropped: a dropped schedule takes its attempts along."""
    return attempts.join(schedules.filter(~c("kept")).select(c("position").alias("schedule_id")), "schedule_id", "left_anti").select(*attempts.columns)
