"""Descriptors: validation, registration, admission and updates.

Validation is an ordered CASE: the first rule broken names the code.  Ids and
bindings are null when unbound.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.names import is_terminal
from sluice.functions.scalars import first_match
from sluice.policy import MAX_DEPENDENCIES, MAX_QUANTUM, MAX_SERVICE, MAX_TICK

c = F.col


def unbound(*names: str) -> Column:
    """Whether any of the ids or generations is missing."""
    return reduce(or_, [F.coalesce(c(n), F.lit(0)) == 0 for n in names])


def outside(name: str, top: int) -> Column:
    return F.coalesce((c(name) < 1) | (c(name) > top), F.lit(True))


def validate_flow() -> Column:
    """The code of the first rule that a flow descriptor breaks, or 'ok'."""
    deps = F.coalesce("dependencies", F.array().cast("array<bigint>"))
    bad, far = "invalid-argument", "out-of-range"
    return first_match(
        [
            (unbound("flow_id"), bad),
            (unbound("generation"), bad),
            (unbound("path_id", "path_generation"), bad),
            (unbound("resource_id", "resource_generation"), bad),
            (unbound("priority_id", "priority_generation"), bad),
            (unbound("qos_id", "qos_generation"), bad),
            (unbound("fairness_group"), bad),
            (unbound("reservation_id") != unbound("reservation_generation"), bad),
            (outside("estimated_work", MAX_SERVICE), far),
            (outside("service_quantum", MAX_QUANTUM), far),
            (c("min_service") > c("estimated_work"), bad),
            ((c("min_service") > 0) & (c("min_service_window") == 0), bad),
            (c("min_service_window") > MAX_TICK, far),
            (c("release_tick") > MAX_TICK, far),
            (c("deadline_tick") > MAX_TICK, far),
            (c("deadline_tick") <= c("release_tick"), bad),
            (outside("weight", MAX_SERVICE), far),
            (F.size(deps) > MAX_DEPENDENCIES, "bound-exceeded"),
            (~c("readiness_signal").between(0, 2), bad),
            (F.size(F.array_distinct(deps)) < F.size(deps), bad),
            (F.array_contains(deps, c("flow_id")), bad),
            (F.exists(deps, lambda x: x.isNull() | (x == 0)), bad),
        ],
        "ok",
    )


def validate_resource() -> Column:
    return first_match([(unbound("resource_id"), "invalid-argument"), (unbound("generation"), "invalid-argument"), (outside("capacity", MAX_SERVICE), "out-of-range"), (outside("interval_ticks", MAX_TICK), "out-of-range"), (outside("max_overlap", MAX_SERVICE), "out-of-range")], "ok")


def validate_reservation() -> Column:
    return first_match(
        [
            (unbound("reservation_id"), "invalid-argument"),
            (unbound("generation"), "invalid-argument"),
            (unbound("resource_id", "resource_generation"), "invalid-argument"),
            (F.coalesce(c("window_end") <= c("window_begin"), F.lit(True)), "invalid-argument"),
            ((c("window_end") > MAX_TICK) | (c("window_begin") > MAX_TICK), "out-of-range"),
            (outside("capacity", MAX_SERVICE), "out-of-range"),
        ],
        "ok",
    )


def validate_priority_class() -> Column:
    return first_match([(unbound("priority_id"), "invalid-argument"), (unbound("generation"), "invalid-argument"), (outside("weight", MAX_SERVICE), "out-of-range")], "ok")


def validate_qos_class() -> Column:
    return first_match([(unbound("qos_id"), "invalid-argument"), (unbound("generation"), "invalid-argument"), (c("max_service_per_dispatch") > MAX_QUANTUM, "out-of-range")], "ok")


def upsert_generations(current: DataFrame, offered: DataFrame, key: str, order: str = "sequence") -> DataFrame:
    """The status of each offered descriptor, in order: the first generation of a key is 1 (or one past the registered one), every next one more.

    An offer that skips or repeats a generation is refused and does not move the key on, so what is accepted is the longest run that counts up from the registered generation.
    """
    known = current.select(c(key), c("generation").alias("_known"))
    ahead = offered.join(known, key, "left").withColumn("_want", F.coalesce("_known", F.lit(0)) + F.dense_rank().over(Window.partitionBy(key).orderBy("generation")))
    first = F.row_number().over(Window.partitionBy(key, "generation").orderBy(order)) == 1
    seen = F.max(F.when(c("_first"), c(order))).over(Window.partitionBy(key).orderBy("generation").rangeBetween(Window.unboundedPreceding, 0))
    marked = ahead.withColumn("_first", first).withColumn("_at", seen)
    run = marked.withColumn("_ok", c("_first") & (c("generation") == c("_want")) & (c("_at") == c(order)))
    return run.select(*offered.columns, F.when(c("_ok"), "ok").otherwise("invalid-argument").alias("status"))


def register_reservations(offered: DataFrame, resources: DataFrame) -> DataFrame:
    """The status of reservations offered: well formed, on a registered resource, at its generation."""
    known = resources.select("resource_id", c("generation").alias("_generation"))
    status = first_match([(c("_valid") != "ok", c("_valid")), (c("_generation").isNull(), "unknown-resource"), (c("_generation") != c("resource_generation"), "stale-resource-generation")], "ok")
    return offered.withColumn("_valid", validate_reservation()).join(known, "resource_id", "left").select(*offered.columns, status.alias("status"))


def retire_reservations(reservations: DataFrame, named: DataFrame) -> DataFrame:
    """(reservation_id, status, retired) for each request (reservation_id, request_generation); retiring again is no error."""
    found = named.join(reservations.select("reservation_id", "generation", "retired"), "reservation_id", "left")
    status = first_match([(c("generation").isNull(), "unknown-reservation"), (c("generation") != c("request_generation"), "stale-reservation-generation")], "ok")
    return found.select("reservation_id", "request_generation", status.alias("status"), F.coalesce(c("retired") | (status == "ok"), F.lit(False)).alias("retired"))


def _bound(flows: DataFrame, resources: DataFrame, priorities: DataFrame, qos: DataFrame, reservations: DataFrame) -> DataFrame:
    """Flows with the generations at which what they bind is registered."""
    return (
        flows.join(resources.select("resource_id", c("generation").alias("_resource")), "resource_id", "left")
        .join(priorities.select("priority_id", c("generation").alias("_priority"), "rank"), "priority_id", "left")
        .join(qos.select("qos_id", c("generation").alias("_qos"), "preemption_protected", "max_service_per_dispatch"), "qos_id", "left")
        .join(reservations.filter(~c("retired")).select("reservation_id", c("generation").alias("_reservation"), c("resource_id").alias("_on")), "reservation_id", "left")
    )


def binding_arms() -> list[tuple[Column, str]]:
    """What may be wrong with a flow's bindings, in order."""
    bound = c("reservation_id").isNotNull()
    return [
        (c("_resource").isNull(), "unknown-resource"),
        (c("_resource") != c("resource_generation"), "stale-resource-generation"),
        (c("_priority").isNull(), "unknown-policy"),
        (c("_priority") != c("priority_generation"), "stale-priority-generation"),
        (c("_qos").isNull(), "unknown-policy"),
        (c("_qos") != c("qos_generation"), "stale-qos-generation"),
        (bound & c("_reservation").isNull(), "unknown-reservation"),
        (bound & (c("_reservation") != c("reservation_generation")), "stale-reservation-generation"),
        (bound & (c("_on") != c("resource_id")), "invalid-argument"),
    ]


def admission_status() -> Column:
    """The code of an admission, over flows joined with what they bind; _valid and _again say whether the descriptor is well formed and its id taken."""
    return first_match([(c("_valid") != "ok", c("_valid")), (c("_again"), "already-exists"), *binding_arms()], "ok")


def admit_flows(offered: DataFrame, resources: DataFrame, priorities: DataFrame, qos: DataFrame, reservations: DataFrame, order: str | None = None) -> DataFrame:
    """offered with the status of its admission; of several valid offers of one id the first stays."""
    rows = offered.withColumn("_valid", validate_flow())
    if order is None:
        rows = rows.withColumn("_again", F.lit(False))
    else:
        rank = F.row_number().over(Window.partitionBy("flow_id", c("_valid") == "ok").orderBy(order))
        rows = rows.withColumn("_again", (c("_valid") == "ok") & (rank > 1))
    return _bound(rows, resources, priorities, qos, reservations).withColumn("status", admission_status()).select(*offered.columns, "status")


def update_flows(state: DataFrame, offered: DataFrame, resources: DataFrame, priorities: DataFrame, qos: DataFrame, reservations: DataFrame) -> DataFrame:
    """(flow_id, generation, status, releases_window) of updates offered: one generation on, all bindings known, and no change of work or dependencies once served.

    state: flows joined with their state.  releases_window says that the flow holds a scheduled window under its old generation.
    """
    old = state.select("flow_id", c("generation").alias("_generation"), c("dependencies").alias("_deps"), c("estimated_work").alias("_work"), "lifecycle", "served_work")
    rows = _bound(offered.withColumn("_valid", validate_flow()).join(old, "flow_id", "left"), resources, priorities, qos, reservations)
    frozen = ((F.size("_deps") > 0) | (F.size("dependencies") > 0) | (c("_work") != c("estimated_work"))) & (c("lifecycle") != "waiting") & (c("served_work") > 0)
    status = first_match(
        [
            (c("_valid") != "ok", c("_valid")),
            (c("_generation").isNull(), "unknown-flow"),
            (c("generation") != c("_generation") + 1, "invalid-argument"),
            (frozen, "invalid-state"),
            *binding_arms(),
        ],
        "ok",
    )
    return rows.select("flow_id", "generation", status.alias("status"), F.coalesce((status == "ok") & (c("lifecycle") == "scheduled"), F.lit(False)).alias("releases_window"))


def retire_flows(state: DataFrame, named: DataFrame) -> DataFrame:
    """The status of retiring flows by (flow_id, request_generation): only a terminal flow goes."""
    found = named.join(state.select("flow_id", "generation", "lifecycle"), "flow_id", "left")
    status = first_match([(c("generation").isNull(), "unknown-flow"), (c("generation") != c("request_generation"), "stale-flow-generation"), (~is_terminal(c("lifecycle")), "invalid-state")], "ok")
    return found.select("flow_id", "request_generation", status.alias("status"))
