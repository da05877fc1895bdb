"""Who may run at a tick: dependencies, reservation windows, and the ordered classification over them.

All functions take flows joined with their state (one row a flow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.names import is_terminal
from sluice.functions.scalars import first_match, window_contains
from sluice.sources.shared import written

c = F.col


def dependency_gate(flows: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """(flow_id, deps_met, deps_failed) of flows that have dependencies: all of them completed; one of them ended otherwise.

    A dependency that is unknown or retired is not met, and not failed either.
    """
    need = flows.filter(F.size("dependencies") > 0).select("flow_id", F.explode("dependencies").alias("_dep"))
    found = need.join(lifecycles.select(c("flow_id").alias("_dep"), c("lifecycle").alias("_state")), "_dep", "left")
    done = F.coalesce(c("_state") == "completed", F.lit(False))
    lost = F.coalesce(is_terminal(c("_state")) & (c("_state") != "completed"), F.lit(False))
    return found.groupBy("flow_id").agg(F.bool_and(done).alias("deps_met"), F.bool_or(lost).alias("deps_failed"))


def exclusively_held(reservations: DataFrame, now: int) -> DataFrame:
    """(resource_id) of resources on which an exclusive reservation is open."""
    return reservations.filter(~c("retired") & c("exclusive") & window_contains(c("window_begin"), c("window_end"), now)).select("resource_id").distinct()


def exclusive_windows(flows: DataFrame, reservations: DataFrame, now: int) -> DataFrame:
    """Flows without a reservation on whose resource an exclusive one is open: a semi join on the resource and the interval."""
    return flows.filter(c("reservation_id").isNull()).join(exclusively_held(reservations, now), "resource_id", "left_semi")


def reservation_reason(now: int) -> Column:
    """Why a bound reservation cannot be used, or null; over _res_* columns of the reservation found."""
    return first_match(
        [
            (c("_res_generation").isNull() | c("_res_retired"), "reservation-window-closed"),
            (c("_res_generation") != c("reservation_generation"), "reservation-window-closed"),
            (c("_res_resource") != c("resource_id"), "reservation-window-closed"),
            (F.lit(now) < c("_res_begin"), "awaiting-reservation-window"),
            (F.lit(now) >= c("_res_end"), "reservation-window-closed"),
            (c("_res_used") >= c("_res_capacity"), "reservation-exhausted"),
        ],
        None,
    )


def with_reservation(flows: DataFrame, reservations: DataFrame) -> DataFrame:
    """Flows with the reservation that they name, as _res_* columns."""
    named = reservations.select(
        "reservation_id",
        c("generation").alias("_res_generation"),
        c("resource_id").alias("_res_resource"),
        c("window_begin").alias("_res_begin"),
        c("window_end").alias("_res_end"),
        c("capacity").alias("_res_capacity"),
        c("reserved_units").alias("_res_used"),
        c("retired").alias("_res_retired"),
    )
    return flows.join(named, "reservation_id", "left")


def classify(flows: DataFrame, reservations: DataFrame, now: int, keep_gate: bool = False) -> DataFrame:
    """flows with reason: 'selected' if ready, else the first rule in order that keeps the flow back.

    keep_gate: write the gate, for a result that is read several times.
    """
    bound = c("reservation_id").isNotNull()
    signal = c("readiness_signal")
    before = [
        (is_terminal(c("lifecycle")), "terminal"),
        (c("lifecycle") == "ambiguous", "ambiguous-requires-resolution"),
        ((c("lifecycle") == "waiting") & (F.lit(now) < c("release_tick")), "awaiting-release"),
        (signal == 2, "awaiting-readiness-signal"),
        (~c("auto_ready") & (signal != 1), "awaiting-readiness-signal"),
        (F.lit(now) < c("release_tick"), "awaiting-release"),
    ]
    # the gate is asked only for flows that have dependencies and that no rule before it keeps back; no other row is dealt by its id
    gated = F.coalesce((F.size("dependencies") > 0) & first_match(before, None).isNull(), F.lit(False))
    asked = flows.filter(gated)
    gate = dependency_gate(asked, flows)
    asked = asked.join(written(gate, "gate")[0] if keep_gate else gate, "flow_id", "left")
    free = flows.filter(~gated).withColumns({k: F.lit(None).cast("boolean") for k in ("deps_met", "deps_failed")})
    held = exclusively_held(reservations, now).withColumn("_excluded", F.lit(True))
    rows = with_reservation(asked.unionByName(free), reservations).join(held, "resource_id", "left")
    reason = first_match(
        [
            *before,
            (F.coalesce(~c("deps_met") & c("deps_failed"), F.lit(False)), "dependency-failed"),
            (F.coalesce(~c("deps_met"), F.lit(False)), "awaiting-dependency"),
            (~bound & c("_excluded").isNotNull(), "awaiting-reservation-window"),
            (bound & reservation_reason(now).isNotNull(), reservation_reason(now)),
            (F.coalesce(c("deadline_tick") <= now, F.lit(False)), "deadline-missed"),
        ],
        "selected",
    )
    return rows.select(*flows.columns, reason.alias("reason"), c("_res_capacity"), c("_res_used"), c("_res_end"))


def cascade(flows: DataFrame, now: int, failing: DataFrame | None = None) -> DataFrame:
    """(flow_id, depth) of waiting flows that fail in this round because a dependency has failed, or fails in it.

    A round visits flows by ascending id, so a failure reaches a higher id at once and a lower one in the next round.  Each
    pass is one join on ids of the flows that failed in the last one; passes go on until none fails anew, at most as many as
    the longest chain of dependencies.  failing: (flow_id) of flows that fail in this round for another reason.
    """
    spark, signal = flows.sparkSession, c("readiness_signal")
    open_ = flows.filter((c("lifecycle") == "waiting") & (c("release_tick") <= now) & (signal != 2) & (c("auto_ready") | (signal == 1)))
    edges = open_.select("flow_id", F.explode("dependencies").alias("dep"))
    lost = flows.filter(is_terminal(c("lifecycle")) & (c("lifecycle") != "completed")).select(c("flow_id").alias("dep"))
    reached = edges.join(lost, "dep", "left_semi").select("flow_id").distinct().withColumn("depth", F.lit(1).cast("long"))
    reached, _ = written(reached, "cascade")
    last = reached.select("flow_id").unionByName(failing.select("flow_id")) if failing is not None else reached.select("flow_id")
    depth = 1
    while not last.isEmpty():
        depth += 1
        next_ = edges.join(last.select(c("flow_id").alias("dep")), "dep").filter(c("flow_id") > c("dep")).select("flow_id").distinct().join(reached, "flow_id", "left_anti")
        next_, _ = written(next_.withColumn("depth", F.lit(depth).cast("long")), "cascade")
        last = next_.select("flow_id")
        reached = reached.unionByName(next_)
    return reached
