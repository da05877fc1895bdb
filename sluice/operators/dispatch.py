"""From a schedule entry to a running attempt: authority is checked field by field, the first mismatch names the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.digests import fnv
from sluice.functions.names import is_attempt_terminal
from sluice.functions.scalars import first_match, window_contains
from sluice.operators.ranking import numbered
from sluice.policy import Policy

c = F.col
#: Fields that a ticket's digest covers, in order.
TICKET_FIELDS = (
    "attempt_id", "epoch", "schedule_id", "schedule_generation", "flow_id", "flow_generation", "path_id", "path_generation", "resource_id", "resource_generation", "reservation_id", "reservation_generation",
    "qos_id", "qos_generation", "priority_id", "priority_generation", "policy_id", "policy_generation", "worker", "boot", "start_tick", "deadline_tick", "quantum",
)


def with_registries(tickets: DataFrame, flows: DataFrame, resources: DataFrame, priorities: DataFrame, qos: DataFrame, reservations: DataFrame) -> DataFrame:
    """Tickets with what is registered now under each id that they name, as _now_* columns."""
    generation = lambda frame, key, name: frame.select(c(key), c("generation").alias(name))
    rows = tickets.join(flows.select("flow_id", c("generation").alias("_now_flow"), c("path_id").alias("_now_path"), c("path_generation").alias("_now_path_generation")), "flow_id", "left")
    rows = rows.join(generation(resources, "resource_id", "_now_resource"), "resource_id", "left")
    rows = rows.join(generation(priorities, "priority_id", "_now_priority"), "priority_id", "left")
    rows = rows.join(generation(qos, "qos_id", "_now_qos"), "qos_id", "left")
    held = reservations.select("reservation_id", c("generation").alias("_now_reservation"), c("retired").alias("_now_retired"), c("window_begin").alias("_now_begin"), c("window_end").alias("_now_end"))
    return rows.join(held, "reservation_id", "left")


def ticket_status(policy: Policy, epoch: int, now: int) -> Column:
    """The code of the first check that a ticket fails, or 'ok'."""
    reserved = c("reservation_id").isNotNull()
    return first_match(
        [
            (F.coalesce(c("epoch") != epoch, F.lit(True)), "stale-epoch"),
            ((c("policy_id") != policy.policy_id) | (c("policy_generation") != policy.generation), "stale-policy-generation"),
            (c("_now_flow").isNull(), "unknown-flow"),
            (c("_now_flow") != c("flow_generation"), "stale-flow-generation"),
            ((c("_now_path") != c("path_id")) | (c("_now_path_generation") != c("path_generation")), "stale-path-generation"),
            (c("_now_resource").isNull(), "unknown-resource"),
            (c("_now_resource") != c("resource_generation"), "stale-resource-generation"),
            (c("_now_priority").isNull(), "unknown-policy"),
            (c("_now_priority") != c("priority_generation"), "stale-priority-generation"),
            (c("_now_qos").isNull(), "unknown-policy"),
            (c("_now_qos") != c("qos_generation"), "stale-qos-generation"),
            (reserved & (c("_now_reservation").isNull() | c("_now_retired")), "reservation-closed"),
            (reserved & (c("_now_reservation") != c("reservation_generation")), "stale-reservation-generation"),
            (reserved & ~window_contains(c("_now_begin"), c("_now_end"), now), "reservation-closed"),
            (~reserved & c("reservation_generation").isNotNull(), "invalid-argument"),
            (F.coalesce(c("deadline_tick") <= now, F.lit(False)), "deadline-passed"),
        ],
        "ok",
    )


def validate_tickets(tickets: DataFrame, flows: DataFrame, resources: DataFrame, priorities: DataFrame, qos: DataFrame, reservations: DataFrame, policy: Policy, epoch: int, now: int) -> DataFrame:
    """tickets with status."""
    return with_registries(tickets, flows, resources, priorities, qos, reservations).withColumn("status", ticket_status(policy, epoch, now)).select(*tickets.columns, "status")


def ticket_digest() -> Column:
    return fnv(*[c(f) for f in TICKET_FIELDS])


def revalidate(tickets: DataFrame, validated_status: str = "status") -> DataFrame:
    """tickets (with digest and status) whose digest does not match their fields get the code of a contradiction instead."""
    return tickets.withColumn("status", first_match([(F.coalesce(c("digest"), F.lit(0)) == 0, "invalid-argument"), (ticket_digest() != c("digest"), "contradictory-completion")], c(validated_status)))


def begin_dispatch(requests: DataFrame, entries: DataFrame, state: DataFrame, registries: tuple[DataFrame, ...], policy: Policy, epoch: int, now: int, next_attempt: int) -> DataFrame:
    """The status of dispatch requests (request, schedule_id, schedule_generation, ordinal, worker, boot), and the attempt minted for each that passes, by request order.

    registries: flows, resources, priorities, qos and reservations as registered now; an entry must still hold under all of
    them, and under the policy it was issued by, before an attempt is minted.
    """
    headers = entries.groupBy("schedule_id").agg(F.max("schedule_generation").alias("_generation"), F.max("epoch").alias("_epoch"), F.count("ordinal").alias("_n"))
    bound = [f for f in TICKET_FIELDS if f in entries.columns and f not in ("schedule_id", "schedule_generation", "epoch", "flow_id", "quantum")]
    own = entries.select("schedule_id", "ordinal", "kind", "consumed", "flow_id", *bound)
    held = state.select("flow_id", c("generation").alias("_flow_generation"), "lifecycle", "scheduled_schedule")
    rows = requests.join(headers, "schedule_id", "left").join(own, ["schedule_id", "ordinal"], "left").join(held, "flow_id", "left")
    rows = with_registries(rows.withColumn("epoch", F.lit(epoch)), *registries)
    authority = ticket_status(policy, epoch, now)
    status = first_match(
        [
            ((F.coalesce(c("worker"), F.lit(0)) == 0) | (F.coalesce(c("boot"), F.lit(0)) == 0), "invalid-argument"),
            (c("_generation").isNull(), "unknown-schedule"),
            (c("_generation") != c("schedule_generation"), "stale-schedule-generation"),
            (c("_epoch") != epoch, "stale-epoch"),
            (c("ordinal") >= c("_n"), "out-of-range"),
            (c("kind") != "run", "invalid-argument"),
            (c("consumed") != 0, "invalid-state"),
            (c("_flow_generation").isNull(), "unknown-flow"),
            ((c("lifecycle") != "scheduled") | (c("scheduled_schedule") != c("schedule_id")), "invalid-state"),
            (c("_flow_generation") != c("flow_generation"), "stale-flow-generation"),
        ],
        authority,
    )
    rows = rows.select("request", "schedule_id", "ordinal", "flow_id", status.alias("status"))
    minted = numbered(rows.filter(c("status") == "ok"), [c("request")], "_place").withColumn("attempt_id", c("_place") + (next_attempt - 1)).drop("_place")
    return minted.unionByName(rows.filter(c("status") != "ok").withColumn("attempt_id", F.lit(None).cast("long")))


def worker_loss(attempts: DataFrame, state: DataFrame, lost: DataFrame) -> DataFrame:
    """(attempt_id, flow_id, state, lifecycle) of the live attempts of lost workers (worker, boot): abandoned, and their flows, ambiguous by that, sent to wait again."""
    gone = attempts.filter(~is_attempt_terminal(c("state"))).join(lost, ["worker", "boot"], "left_semi").select("attempt_id", "flow_id")
    return gone.join(state.select("flow_id", "open_attempt", "lifecycle"), "flow_id", "left").select("attempt_id", "flow_id", F.lit("abandoned").alias("state"), F.when(c("open_attempt") == c("attempt_id"), "waiting").otherwise(c("lifecycle")).alias("lifecycle"))


def mark_started(reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """(report, attempt_id, status, first) of start reports (report, attempt_id); only the first for an open attempt changes anything."""
    rows = reports.join(attempts.select("attempt_id", "state"), "attempt_id", "left")
    status = first_match([(c("state").isNull(), "unknown-attempt"), (is_attempt_terminal(c("state")), "completion-for-closed-attempt")], "ok")
    rank = F.row_number().over(Window.partitionBy("attempt_id").orderBy("report"))
    return rows.select("report", "attempt_id", status.alias("status"), F.coalesce((c("state") == "open") & (rank == 1), F.lit(False)).alias("first"))


def close_attempts(attempts: DataFrame, requests: DataFrame) -> DataFrame:
    """(attempt_id, action, status, state, lifecycle) of requests (attempt_id, action) to abandon or preempt.

    Abandoning a closed attempt is no error, preempting one is.  An abandoned attempt leaves its flow ambiguous, a preempted one ready.
    """
    rows = requests.join(attempts.select("attempt_id", "state"), "attempt_id", "left")
    closed = is_attempt_terminal(c("state"))
    status = first_match([(c("state").isNull(), "unknown-attempt"), (closed & (c("action") == "preempt"), "completion-for-closed-attempt")], "ok")
    acts = c("state").isNotNull() & ~closed
    after = F.when(acts, F.when(c("action") == "preempt", "preempted").otherwise("abandoned")).otherwise(c("state"))
    lifecycle = F.when(acts, F.when(c("action") == "preempt", "ready").otherwise("ambiguous"))
    return rows.select("attempt_id", "action", status.alias("status"), after.alias("state"), lifecycle.alias("lifecycle"))


def worker_evidence(tickets: DataFrame, asked: str = "asked") -> DataFrame:
    """What a worker reports for a ticket: at most the quantum."""
    return tickets.select("attempt_id", "epoch", "schedule_id", "schedule_generation", "flow_id", "flow_generation", "worker", "boot", F.when(c(asked) > 0, "served").otherwise("no-service").alias("outcome"), F.least(c(asked), c("quantum")).alias("served"))
