"""One round: readiness, order and assignment put together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import assign, ranking, readiness
from sluice.policy import Policy
from sluice.sources.shared import written

c = F.col
#: Columns that deciding reads of a candidate or an incumbent.
READ = ("flow_id", "generation", "resource_id", "resource_generation", "_resource", "reservation_id", "reservation_left", "lifecycle", "reason", "tier", "rank", "key_deadline", "key_stamp", "weight", "want", "capacity_left", "in_flight", "max_overlap", "estimated_work", "served_work", "preemption_protected", "preemptible", "deadline_tick", "open_attempt")


@dataclass
class World:
    """The tables that a round reads: flows joined with their state, and what they bind.

    resources also holds in_flight, interval_index and reserved_this_interval.
    """

    flows: DataFrame
    resources: DataFrame
    reservations: DataFrame
    priorities: DataFrame
    qos: DataFrame
    spent: int = 0


def candidates(world: World, policy: Policy, now: int, keep_gate: bool = False) -> DataFrame:
    """All flows with their reason, key, limits and what they may get; the ready ones have reason 'selected'."""
    rows = readiness.classify(world.flows, world.reservations, now, keep_gate)
    rows = ranking.with_key(rows, world.priorities, policy, now)
    qos = world.qos.select("qos_id", c("generation").alias("_qos"), "preemption_protected", "max_service_per_dispatch")
    rows = rows.join(qos, "qos_id", "left")
    for name in ("preemption_protected", "max_service_per_dispatch"):
        rows = rows.withColumn(name, F.when(c("_qos") == c("qos_generation"), c(name)))
    resources = world.resources.select("resource_id", c("generation").alias("_resource"), "capacity", "interval_ticks", "max_overlap", "in_flight", "interval_index", "reserved_this_interval")
    rows = rows.join(resources, "resource_id", "left")
    rows = rows.withColumn("want", assign.wanted(policy, now)).withColumn("capacity_left", assign.capacity_left(now))
    return rows.withColumn("reservation_left", F.greatest(c("_res_capacity") - c("_res_used"), F.lit(0)))


def _open() -> Column:
    """Flows that a round tells about."""
    return c("lifecycle").isin("waiting", "ready", "ambiguous")


def _unbound() -> Column:
    """Flows whose resource is unknown or another than they name."""
    return c("_resource").isNull() | (c("_resource") != c("resource_generation"))


def decide(world: World, policy: Policy, now: int, exact_fold: bool | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The ready flows in full, with grant, decision, victim and victim_attempt, and the other open ones with why they do not run.

    Resources where a ready flow has a reservation, or may displace an incumbent, are folded in order; the others take the
    closed form, which is exact there (exact_fold forces one of the two on all).  Then two cuts apply, both found from a
    bounded number of rows: once the throttle is spent nobody displaces, and once the entries are full nobody runs.
    Only the ready and the incumbents are written for that; the others are told from what world holds, and both from one
    gate.  columns: what is carried along (READ at least) if not all.
    """
    all_ = candidates(world, policy, now, keep_gate=True)
    all_ = all_.select(*columns) if columns else all_
    decided = _decided(all_, world, policy, now, exact_fold)
    why = F.when(c("reason") != "selected", c("reason")).otherwise("resource-unavailable")
    nothing = F.lit(None).cast("long")
    others = all_.filter(_open() & ((c("reason") != "selected") | _unbound())).select("*", F.lit(0).cast("long").alias("grant"), why.alias("decision"), nothing.alias("victim"), nothing.alias("victim_attempt"))
    return decided.unionByName(others)


def decide_ready(world: World, policy: Policy, now: int, exact_fold: bool | None = None) -> DataFrame:
    """The rows of `decide` that are ready and whose resource is as they name it, with what deciding reads of them."""
    return _decided(candidates(world, policy, now).select(*READ), world, policy, now, exact_fold)


def _decided(all_: DataFrame, world: World, policy: Policy, now: int, exact_fold: bool | None) -> DataFrame:
    may, holds = _open() & (c("reason") == "selected") & ~_unbound(), c("open_attempt").isNotNull()
    told = all_.filter((_open() & (c("reason") == "selected")) | holds)  # known before priorities, classes and resources are looked up
    rows, _ = written(told.filter(may | holds), "candidates")  # the flows that wait are not carried along
    ready = rows.filter(may).join(assign.incumbents(rows), "resource_id", "left")
    refusal = F.when(c("worst").isNull(), "concurrency-limit-reached").otherwise(assign.verdict(policy, now, world.spent))
    ready = ready.withColumn("refusal", refusal)
    nothing = F.lit(None).cast("long")
    parts = []
    if exact_fold is None:
        ordered = ready.groupBy("resource_id").agg(F.max((c("reservation_id").isNotNull() | c("refusal").isNull()).cast("int")).alias("_fold"))
        ready = ready.join(ordered, "resource_id")
    else:
        ready = ready.withColumn("_fold", F.lit(int(exact_fold)))
    if exact_fold is not True:
        closed = assign.closed_form(ready.filter(c("_fold") == 0))
        parts.append(closed.withColumn("victim", nothing).withColumn("victim_attempt", nothing))
    if exact_fold is not False:
        hard, held = ready.filter(c("_fold") == 1), rows.filter(holds)
        if exact_fold is None:
            held = held.join(ordered.filter(c("_fold") == 1), "resource_id", "left_semi")
        left = policy.max_preemptions_per_interval - world.spent
        folded = written(assign.fold(hard, held, policy, now, (-1,) if left <= 0 else None), "folded")[0]
        if policy.preemption != "none" and left > 0:
            displacing = hard.join(folded.filter(c("victim").isNotNull()).select("flow_id"), "flow_id", "left_semi").orderBy(*ranking.ordering()).limit(left + 1)
            keys = sorted(assign.key_of(r) for r in displacing.select(*ranking.KEY).collect())  # at most one more than the throttle allows
            if len(keys) > left:
                folded = written(assign.fold(hard, held, policy, now, keys[left - 1]), "folded")[0]
        parts.append(hard.join(folded, "flow_id"))
    decided = reduce(DataFrame.unionByName, [p.select(*ready.columns, c("grant").cast("long").alias("grant"), "decision", "victim", "victim_attempt") for p in parts])
    makes = (c("grant") > 0).cast("int") + c("victim").isNotNull().cast("int")
    first = decided.filter(makes > 0).orderBy(*ranking.ordering()).limit(policy.entry_limit).select(*ranking.KEY, makes.alias("_makes")).collect()  # the entry limit is bounded
    entries = 0
    for r in first:
        entries += r["_makes"]
        if entries >= policy.entry_limit:
            last = zip(assign.key_of(r), ("int", "long", "long", "long", "long", "long", "long"), ("tier", "rank", "d", "key_stamp", "w", "flow_id", "generation"), strict=True)
            late = ranking.order_struct() > F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in last])
            decided = decided.withColumn("_late", late).withColumns({"grant": F.when(c("_late"), F.lit(0).cast("long")).otherwise(c("grant")), "decision": F.when(c("_late"), "schedule-entry-limit-reached").otherwise(c("decision"))})
            decided = decided.withColumns({k: F.when(~c("_late"), c(k)) for k in ("victim", "victim_attempt")}).drop("_late")
            break
    return decided.drop("worst", "incumbents", "refusal", "_fold")


def round_decisions(world: World, policy: Policy, now: int, exact_fold: bool | None = None) -> DataFrame:
    """A row per waiting, ready or ambiguous flow: flow_id, resource_id, tier, grant, decision, victim, victim_attempt."""
    return decide(world, policy, now, exact_fold, READ).select("flow_id", "resource_id", "tier", "grant", "decision", "victim", "victim_attempt")
