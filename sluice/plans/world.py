"""The derived tables put together as the world that a round reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators.arbitrate import World
from sluice.sources.derived import NOW, Tables
from sluice.sources.shared import written

#: What a round reads of a flow and its state.
STATE = (
    "flow_id", "generation", "resource_id", "resource_generation", "reservation_id", "reservation_generation", "priority_id", "qos_id", "qos_generation", "estimated_work", "service_quantum", "min_service",
    "release_tick", "deadline_tick", "weight", "preemptible", "auto_ready", "readiness_signal", "dependencies", "lifecycle", "served_work", "outstanding_reserved", "open_attempt", "eligible_since_tick", "ever_ready",
    "min_service_delivered", "virtual_finish",
)


def world_of(tables: Tables) -> World:
    """All flows and resources; scheduled and running flows are in flight, and each resource has charged some of the interval.

    All tables are derived once and written, so a round reads no base table, and the small ones are known to be small.
    """
    state = tables.written_state(*STATE)
    flight = state.filter(F.col("lifecycle").isin("running", "scheduled")).groupBy("resource_id").agg(F.count("flow_id").alias("_n"))
    resources = tables.resources.join(flight, "resource_id", "left").withColumn("in_flight", F.coalesce("_n", F.lit(0))).drop("_n")
    resources = resources.withColumn("interval_index", F.lit(NOW // 30).cast("long")).withColumn("reserved_this_interval", F.col("resource_id") % 20)
    small = {"resources": resources, "reservations": tables.reservations, "priorities": tables.priority_classes, "qos": tables.qos_classes}
    return World(state, **{name: written(frame.coalesce(1), name)[0] for name, frame in small.items()})
