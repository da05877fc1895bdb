"""Sequences of rounds: state in, state out.

`run_round` runs a round over DataFrames and returns the course after it, all
its effects included: entries, charges, displaced and overdue work, windows taken
back.  `serve` delivers and completes what is pending, and `iterate` repeats both.
They are meant for wide rounds over many resources.
`simulate` runs long sequences over small populations: every resource's flows
are stepped through all rounds in one task, over arrays, resources in parallel.
Both follow the same rules and are tested against each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.digests import SplitMix
from sluice.functions.scalars import div, saturating_add, stamp_cost
from sluice.operators import arbitrate, ranking, readiness
from sluice.policy import MAX_DEFERRED, STAMP_SHIFT, Policy
from sluice.sources.shared import drop_path, written

c = F.col
NONE = 1 << 62
FLOW_SCHEMA = (
    "flow_id long, generation long, path_id long, path_generation long, resource_id long, resource_generation long, reservation_id long, reservation_generation long, priority_id long, priority_generation long, qos_id long, qos_generation long, "
    "fairness_group long, estimated_work long, service_quantum long, min_service long, min_service_window long, release_tick long, deadline_tick long, weight long, preemptible boolean, auto_ready boolean, readiness_signal int, dependencies array<long>"
)
#: What a flow's state is before anything has happened to it.
STATE = {
    "lifecycle": "waiting", "served_work": 0, "outstanding_reserved": 0, "open_attempt": None, "eligible_since_tick": 0, "ever_ready": False, "min_service_window_start": 0, "min_service_delivered": 0, "virtual_finish": 0, "deadline_missed_counted": False, "wait_ticks": 0,
    "starvation_counted": False, "starvation_boosts": 0, "preemptions": 0, "scheduled_schedule": None,
}
KINDS = {"lifecycle": "string", "ever_ready": "boolean", "deadline_missed_counted": "boolean", "starvation_counted": "boolean"}


def completed_state(flows: DataFrame) -> DataFrame:
    """flows with all columns of STATE, those that are missing as before anything has happened."""
    return flows.withColumns({k: F.lit(v).cast(KINDS.get(k, "long")) for k, v in STATE.items() if k not in flows.columns})


def drawn(flows: int, seed: int = 1, priorities: int = 4, groups: int = 4, deadlines: float = 0.5, dependencies: float = 0.25, overlap: int = 8, interval: int = 1000, work: int = 16, quantum: int = 4, resources: int = 1, capacity: int = 64) -> list[dict]:
    """The flows of a seeded population, by the columns of FLOW_SCHEMA.

    A deadline lies as many intervals after the release as it takes to serve all flows once by the capacity, and up to as
    many again.
    """
    draw, rows, names = SplitMix(seed), [], [x.split()[0] for x in FLOW_SCHEMA.split(", ")]
    turns = max(1, flows * 8 // max(1, capacity // quantum))
    for k in range(flows):
        priority, group, release = draw.below(priorities) + 1, draw.below(groups) + 1, k // (overlap * resources) * interval
        deadline = release + interval * (turns + draw.below(turns + 1)) if draw.chance(deadlines) else None
        amount, weight = work * (1 + draw.below(4)), 1 + draw.below(4)
        needs = [k] if k and draw.chance(dependencies) else []
        rows.append(dict(zip(names, (k + 1, 1, k + 1, 1, k % resources + 1, 1, None, None, priority, 1, 1, 1, group, amount, quantum, 0, 0, release, deadline, weight, True, True, 0, needs), strict=True)))
    return rows


def population(spark: SparkSession, flows: int, seed: int = 1, **knobs) -> DataFrame:
    """A seeded population (see drawn) of waiting flows with their state."""
    return completed_state(spark.createDataFrame([tuple(r.values()) for r in drawn(flows, seed, **knobs)], FLOW_SCHEMA))


ENTRY = "schedule_id long, epoch long, at_tick long, ordinal long, kind string, flow_id long, flow_generation long, attempt_id long, resource_id long, resource_generation long, reservation_id long, quantum long, deadline_tick long, tier int, reason string, ordering_digest long"


@dataclass
class Outcome:
    """What a round decided: its entries, every open flow's decision, who missed its deadline, whose window was taken back, and the books of the round."""

    entries: DataFrame
    decisions: DataFrame
    missed: DataFrame
    reclaimed: DataFrame
    displaced: int
    scheduled: bool


@dataclass
class Course:
    """Where a sequence of rounds stands.  pending: entries (schedule_id, at_tick, flow_id, resource_id, quantum) not dispatched yet."""

    world: arbitrate.World
    clocks: DataFrame
    pending: DataFrame
    tick: int = 0
    bucket: int = 0
    next_schedule: int = 1
    epoch: int = 1
    rounds: int = 0
    paths: list[str] = field(default_factory=list)


def begin(world: arbitrate.World, epoch: int = 1) -> Course:
    """The course before its first round; nothing is pending."""
    spark = world.flows.sparkSession
    world = replace(world, flows=completed_state(world.flows))
    return Course(world, spark.createDataFrame([], "fairness_group long, clock long"), spark.createDataFrame([], ENTRY), epoch=epoch)


def _entered(rows: DataFrame, clocks: DataFrame, entering, policy: Policy, now: int) -> DataFrame:
    """rows with those that enter Ready stamped, marked and timed."""
    rows = rows.join(clocks.select("fairness_group", "clock"), "fairness_group", "left")
    start = F.greatest(c("virtual_finish"), F.coalesce(c("clock"), F.lit(0)))
    stamp = saturating_add(start, stamp_cost(F.least(c("service_quantum"), F.lit(policy.max_quantum)), c("weight"))) if policy.weighted_fairness else c("virtual_finish")
    start_, delivered = ranking.min_service_window(now)
    rows = rows.withColumn("_in", entering)
    values = {"virtual_finish": stamp, "min_service_window_start": start_.cast("long"), "min_service_delivered": delivered.cast("long"), "eligible_since_tick": F.lit(now).cast("long"), "ever_ready": F.lit(True), "starvation_counted": F.lit(False), "lifecycle": F.lit("ready")}
    return rows.withColumns({k: F.when(c("_in"), v).otherwise(c(k)) for k, v in values.items()}).drop("_in", "clock")


def _left(leaving, now: int):
    """Ticks waited by a flow that leaves Ready: the longest wait so far."""
    return F.when(leaving & (c("lifecycle") == "ready"), F.greatest(c("wait_ticks"), F.lit(now) - c("eligible_since_tick"))).otherwise(c("wait_ticks"))


def schedule_entries(decided: DataFrame, flows: DataFrame, schedule: int, epoch: int, now: int) -> DataFrame:
    """Rows of ENTRY, numbered in the order of the candidates: a displacement comes right before the window it makes room for, with its candidate's tier and digest."""
    made = decided.filter((c("grant") > 0) | c("victim").isNotNull())
    run = F.struct(F.lit("run").alias("kind"), c("flow_id").alias("of"), c("grant").alias("units"))
    stop = F.struct(F.lit("preempt").alias("kind"), c("victim").alias("of"), F.lit(None).cast("long").alias("units"))
    both = made.withColumn("_e", F.explode(F.filter(F.array(F.when(c("victim").isNotNull(), stop), F.when(c("grant") > 0, run)), lambda x: x.isNotNull())))
    place = F.row_number().over(Window.orderBy(*ranking.ordering(), c("_e.kind")))  # at most as many rows as a schedule may hold
    keyed = both.select(F.lit(schedule).cast("long").alias("schedule_id"), F.lit(epoch).cast("long").alias("epoch"), F.lit(now).cast("long").alias("at_tick"), (place - 1).cast("long").alias("ordinal"), c("_e.kind").alias("kind"), c("_e.of").alias("flow_id"), c("_e.units").alias("_units"), F.when(c("_e.kind") == "preempt", c("victim_attempt")).alias("attempt_id"), "tier", ranking.key_digest().alias("ordering_digest"))
    named = flows.select("flow_id", c("generation").alias("flow_generation"), "resource_id", "resource_generation", "reservation_id", "deadline_tick", "outstanding_reserved")
    reason = F.when(c("kind") == "run", "selected").otherwise("displaced-by-higher-authority")
    out = keyed.join(named, "flow_id").withColumn("quantum", F.coalesce("_units", "outstanding_reserved")).withColumn("reason", reason)
    return out.select(*[x.split()[0] for x in ENTRY.split(", ")])


def run_round(course: Course, policy: Policy, now: int) -> tuple[Course, Outcome]:
    """One round: windows not delivered go back, who may run is found, overdue work is stopped, and what is decided is charged.

    The tick must not go back.  All that the round reads and leaves is written to the shared folder, so its plan does not
    grow with the rounds.
    """
    if now < course.tick:
        raise ValueError("invalid-argument: a round's tick lies before the last one's")
    world, clocks, keep = course.world, course.clocks, []
    columns = world.flows.columns

    def kept(frame: DataFrame, what: str) -> DataFrame:
        frame, path = written(frame, what)
        keep.append(path)
        return frame

    # windows beyond the delivery horizon go back; what they charged stays charged
    due = course.pending.filter((c("kind") == "run") & (c("at_tick") + policy.dispatch_delivery_horizon <= now)).select("flow_id", c("schedule_id").alias("_s"), c("quantum").alias("_q"))
    rows = world.flows.join(due, "flow_id", "left").withColumn("_back", F.coalesce((c("lifecycle") == "scheduled") & (c("scheduled_schedule") == c("_s")), F.lit(False)))
    rows = rows.withColumns({"outstanding_reserved": F.when(c("_back"), F.greatest(c("outstanding_reserved") - c("_q"), F.lit(0))).otherwise(c("outstanding_reserved")), "scheduled_schedule": F.when(~c("_back"), c("scheduled_schedule"))})
    rows = kept(_entered(rows, clocks, c("_back"), policy, now).select(*columns, "_back"), "reclaimed")
    reclaimed = rows.filter("_back").select("flow_id", "resource_id")

    # who becomes ready, who misses a deadline, and whom a failed dependency takes along
    rows = rows.drop("_back")
    told = kept(readiness.classify(rows, world.reservations, now).select("*"), "classified")
    waiting, open_ = c("lifecycle") == "waiting", c("lifecycle").isin("waiting", "ready")
    missed = open_ & (c("reason") == "deadline-missed")
    fails = missed & F.lit(policy.strict_deadlines) & (F.lit(policy.fail_overdue_after_preemption) | ~c("deadline_missed_counted"))
    along = readiness.cascade(rows, now, told.filter(waiting & fails)).select("flow_id", F.lit(True).alias("_along"))
    overdue = c("open_attempt").isNotNull() & F.coalesce(c("deadline_tick") <= now, F.lit(False))
    told = told.join(along, "flow_id", "left").withColumn("_fails", fails | F.coalesce(c("_along"), F.lit(False)) | (open_ & (c("reason") == "dependency-failed")))
    told = told.withColumns({"_missed": (missed | overdue) & ~c("deadline_missed_counted"), "_stopped": overdue, "_ready": waiting & (c("reason") == "selected")})
    told = told.withColumns({"wait_ticks": _left(c("_fails"), now), "deadline_missed_counted": c("deadline_missed_counted") | c("_missed")})
    told = told.withColumns({
        "lifecycle": F.when(c("_fails"), "failed").when(c("_stopped"), "preempting").otherwise(c("lifecycle")),
        "open_attempt": F.when(~c("_stopped"), c("open_attempt")),
        "outstanding_reserved": F.when(c("_stopped"), F.lit(0).cast("long")).otherwise(c("outstanding_reserved")),
        "preemptions": c("preemptions") + c("_stopped").cast("long"),
        "scheduled_schedule": F.when(~c("_stopped"), c("scheduled_schedule")),
    })
    flows = kept(_entered(told, clocks, c("_ready"), policy, now).select(*columns, "_missed", "_stopped"), "refreshed")
    missed_now, stopped = flows.filter("_missed").select("flow_id"), flows.filter("_stopped").select("flow_id", "resource_id")
    flows = flows.drop("_missed", "_stopped")

    # the decision, with a throttle that starts anew with its interval
    gone = reclaimed.select("resource_id").unionByName(stopped.select("resource_id")).groupBy("resource_id").agg(F.count(F.lit(1)).alias("_gone"))
    resources = kept(world.resources.join(gone, "resource_id", "left").withColumn("in_flight", F.greatest(c("in_flight") - F.coalesce("_gone", F.lit(0)), F.lit(0))).select(*world.resources.columns), "resources")
    bucket = now // policy.preemption_interval_ticks
    spent = world.spent if bucket == course.bucket else 0
    decided = kept(arbitrate.decide(arbitrate.World(flows, resources, world.reservations, world.priorities, world.qos, spent), policy, now), "decided")
    entries = kept(schedule_entries(decided, flows, course.next_schedule, course.epoch, now), "entries")

    # what the entries charge, and what becomes of the displaced
    granted = entries.filter(c("kind") == "run")
    clock = ranking.group_clocks(flows.join(granted.select("flow_id"), "flow_id", "left_semi")) if policy.weighted_fairness else clocks.limit(0)
    clocks = kept(clocks.unionByName(clock).groupBy("fairness_group").agg(F.max("clock").alias("clock")), "clocks")
    marks = entries.select("flow_id", c("kind").alias("_kind"), c("quantum").alias("_units"))
    boosted = decided.filter((c("tier") == 1) & (c("reason") == "selected")).select("flow_id", F.lit(True).alias("_boost"))
    rows = flows.join(marks, "flow_id", "left").join(boosted, "flow_id", "left")
    runs, out = F.coalesce(c("_kind") == "run", F.lit(False)), F.coalesce(c("_kind") == "preempt", F.lit(False))
    boost = F.coalesce(c("_boost"), F.lit(False)) & ~c("starvation_counted")
    rows = rows.withColumns({
        "wait_ticks": _left(runs, now),
        "starvation_boosts": c("starvation_boosts") + boost.cast("long"),
        "starvation_counted": c("starvation_counted") | boost,
        "outstanding_reserved": F.when(runs, c("outstanding_reserved") + c("_units")).when(out, F.lit(0).cast("long")).otherwise(c("outstanding_reserved")),
        "scheduled_schedule": F.when(runs, F.lit(course.next_schedule).cast("long")).when(~out, c("scheduled_schedule")),
        "open_attempt": F.when(~out, c("open_attempt")),
        "preemptions": c("preemptions") + out.cast("long"),
        "lifecycle": F.when(runs, "scheduled").when(out, "preempting").otherwise(c("lifecycle")),
    })
    flows = kept(_entered(rows, clocks, c("lifecycle") == "preempting", policy, now).select(*columns), "flows")
    charged = entries.groupBy("resource_id").agg(F.sum(F.when(c("kind") == "run", c("quantum")).otherwise(F.lit(0))).alias("_units"), F.sum(F.when(c("kind") == "run", 1).otherwise(-1)).alias("_net"))
    index = div(F.lit(now).cast("long"), c("interval_ticks"))
    resources = resources.join(charged, "resource_id", "left").withColumn("_same", F.coalesce(c("interval_index") == index, F.lit(False)))
    touched = c("_units").isNotNull()
    resources = resources.withColumns({
        "reserved_this_interval": F.when(touched, F.when(c("_same"), c("reserved_this_interval")).otherwise(F.lit(0)) + c("_units")).otherwise(c("reserved_this_interval")).cast("long"),
        "interval_index": F.when(touched, index).otherwise(c("interval_index")),
        "in_flight": F.greatest(c("in_flight") + F.coalesce("_net", F.lit(0)), F.lit(0)).cast("long"),
    })
    resources = kept(resources.select(*world.resources.columns), "resources")
    booked = granted.filter(c("reservation_id").isNotNull()).groupBy("reservation_id").agg(F.sum("quantum").alias("_units"))
    reservations = kept(world.reservations.join(booked, "reservation_id", "left").withColumn("reserved_units", c("reserved_units") + F.coalesce("_units", F.lit(0))).select(*world.reservations.columns), "reservations")
    displaced = entries.filter(c("kind") == "preempt").count()
    scheduled = not entries.isEmpty()
    pending = kept(course.pending.join(reclaimed.select("flow_id"), "flow_id", "left_anti").select(*entries.columns).unionByName(granted), "pending")
    after = arbitrate.World(flows, resources, reservations, world.priorities, world.qos, spent + displaced)
    told = Outcome(entries, decided, missed_now, reclaimed.select("flow_id"), displaced, scheduled)
    return replace(course, world=after, clocks=clocks, pending=pending, tick=now, bucket=bucket, next_schedule=course.next_schedule + scheduled, rounds=course.rounds + 1, paths=keep), told


def serve(course: Course, policy: Policy, now: int) -> Course:
    """The course once every pending window is delivered and reported as served in full; who has work left is looked at again at once."""
    world, columns = course.world, course.world.flows.columns
    done = course.pending.groupBy("flow_id").agg(F.sum("quantum").alias("_units"))
    rows = world.flows.join(done, "flow_id", "left")
    hit, units = c("_units").isNotNull(), F.coalesce("_units", F.lit(0))
    rows = rows.withColumns({"served_work": c("served_work") + units, "min_service_delivered": c("min_service_delivered") + units, "outstanding_reserved": F.greatest(c("outstanding_reserved") - units, F.lit(0)), "scheduled_schedule": F.when(~hit, c("scheduled_schedule"))})
    rows = rows.withColumn("lifecycle", F.when(hit, F.when(c("served_work") >= c("estimated_work"), "completed").otherwise("waiting")).otherwise(c("lifecycle")))
    rows, path = written(rows.select(*columns, hit.alias("_hit")), "served")
    again = readiness.classify(rows, world.reservations, now).filter(c("_hit") & (c("lifecycle") == "waiting") & (c("reason") == "selected")).select("flow_id", F.lit(True).alias("_again"))
    flows, flows_path = written(_entered(rows.join(again, "flow_id", "left"), course.clocks, F.coalesce(c("_again"), F.lit(False)), policy, now).select(*columns), "flows")
    free = course.pending.groupBy("resource_id").agg(F.count("flow_id").alias("_n"))
    resources = world.resources.join(free, "resource_id", "left").withColumn("in_flight", F.greatest(c("in_flight") - F.coalesce("_n", F.lit(0)), F.lit(0))).select(*world.resources.columns)
    resources, resources_path = written(resources, "resources")
    return replace(course, world=replace(world, flows=flows, resources=resources), pending=course.pending.limit(0), paths=[*course.paths, path, flows_path, resources_path])


def iterate(world: arbitrate.World, policy: Policy, ticks: list[int]) -> arbitrate.World:
    """The world after rounds at ticks, each of whose windows are served at once."""
    course = begin(world)
    for now in ticks:
        before = course.paths
        course, _ = run_round(course, policy, now)
        course = serve(course, policy, now)
        drop_path(world.flows.sparkSession, *before)
    return course.world


def deferred(outcome: Outcome, limit: int = MAX_DEFERRED) -> tuple[DataFrame, bool]:
    """(flow_id, reason) of the first flows that do not run, those that are not ready by id and then the candidates in order; and whether there are more."""
    late = (c("reason") == "selected").cast("int")
    rows = outcome.decisions.filter(c("decision") != "selected")
    cut = rows.orderBy(late, F.when(late == 0, c("flow_id")), *ranking.ordering()).limit(limit).select("flow_id", c("decision").alias("reason"))
    return cut, rows.limit(limit + 1).count() > limit


SIMULATED = "flow_id long, resource_id long, lifecycle string, served_work long, dispatches long, wait_ticks long, rounds long, waits array<long>"


def _steps(frame: pd.DataFrame, capacity: int, interval: int, overlap: int, policy: Policy, step: int, rounds: int, ticks: list[int] | None) -> pd.DataFrame:
    """All rounds of one resource over arrays; windows are served at once, so nothing is in flight when a round begins."""
    f = frame.sort_values("flow_id").reset_index(drop=True)
    n, ids = len(f), f["flow_id"].to_numpy(np.int64)
    column = lambda name: f[name].to_numpy(np.int64)
    work, quantum, release, weight, rank, group = (column(k) for k in ("estimated_work", "service_quantum", "release_tick", "weight", "rank", "fairness_group"))
    deadline = f["deadline_tick"].fillna(NONE).to_numpy(np.int64)
    place = {int(k): i for i, k in enumerate(ids)}
    needs = [[place.get(int(d), -1) for d in deps] for deps in f["dependencies"]]
    cost = (np.minimum(quantum, policy.max_quantum) << STAMP_SHIFT) // np.maximum(weight, 1)
    served, stamp, since, waits, sent = (np.zeros(n, np.int64) for _ in range(5))
    each: list[list[int]] = [[] for _ in range(n)]
    ready, failed, done = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    clock = dict.fromkeys(group.tolist(), 0)
    index, used, now, turn = -1, 0, 0, 0
    bound = np.zeros(n, np.int64)
    followers: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(needs):
        for d in own:
            if d >= 0:
                followers[d].append(i)
    coming, arrived = np.argsort(release, kind="stable").tolist(), 0
    look: list[int] = []  # places of waiting flows to look at in the next round: something that they wait for has changed

    def enter(i: int) -> None:
        stamp[i] = max(stamp[i], clock[int(group[i])]) + cost[i]
        since[i], ready[i] = now, True

    while turn < rounds:
        now = ticks[turn] if ticks else now
        while arrived < n and release[coming[arrived]] <= now:
            look.append(coming[arrived])
            arrived += 1
        heapify(look)
        after: list[int] = []
        while look:  # by ascending id: a failure reaches higher ids at once and lower ones in the next round
            i = heappop(look)
            if ready[i] or failed[i] or done[i] or release[i] > now:
                continue
            met = all(d >= 0 and done[d] for d in needs[i])
            if met and deadline[i] > now:
                enter(i)
            elif policy.strict_deadlines if met else any(d >= 0 and failed[d] for d in needs[i]):
                failed[i] = True
                for k in followers[i]:
                    if k > i:
                        heappush(look, k)
                    else:
                        after.append(k)
        look = after
        late = ready & (deadline <= now)
        if late.any():
            ready &= ~late
            if policy.strict_deadlines:
                failed |= late
                look += [k for i in np.flatnonzero(late).tolist() for k in followers[i]]
        if now // interval != index:
            index, used = now // interval, 0
        own = np.flatnonzero(ready)
        if len(own):
            slack = np.maximum(deadline[own] - now, 0)
            tier = np.where(policy.deadline_ordering & (deadline[own] < NONE) & (slack <= policy.deadline_urgency_ticks), 0, np.where(now - since[own] >= policy.starvation_bound_ticks, 1, 3))
            key = deadline[own] if policy.deadline_ordering else bound[own]
            order = own[np.lexsort((ids[own], -weight[own], stamp[own] if policy.weighted_fairness else bound[own], key, rank[own], tier))]
            slots, granted = overlap, []
            for i in order.tolist():
                if slots == 0 or used >= capacity:
                    break
                want = min(int(quantum[i]), int(work[i] - served[i]), policy.max_quantum, capacity - used)
                if policy.strict_deadlines and deadline[i] < NONE:
                    want = min(want, int(deadline[i] - now))
                if want > 0:
                    slots, used = slots - 1, used + want
                    granted.append((i, want))
            for i, _ in granted:
                clock[int(group[i])] = max(clock[int(group[i])], int(stamp[i]))
            for i, want in granted:
                waits[i] = max(waits[i], now - since[i])
                each[i].append(int(now - since[i]))
                served[i] += want
                sent[i] += 1
                ready[i] = False
                if served[i] >= work[i]:
                    done[i] = True
                    look += followers[i]
                else:
                    enter(i)
        turn += 1
        if not ticks and not look and arrived == n and not ready.any():
            break  # who still waits, waits for what never comes
        now += step
    lifecycle = np.where(done, "completed", np.where(failed, "failed", np.where(ready, "ready", "waiting")))
    return pd.DataFrame({"flow_id": ids, "resource_id": f["resource_id"], "lifecycle": lifecycle, "served_work": served, "dispatches": sent, "wait_ticks": waits, "rounds": turn, "waits": each})


def simulate(flows: DataFrame, resources: DataFrame, priorities: DataFrame, policy: Policy, step: int = 1000, rounds: int = 1 << 20, ticks: list[int] | None = None) -> DataFrame:
    """What becomes of each flow when rounds are run every step ticks until nothing is left to do, or at ticks; waits holds the wait before each dispatch.

    For populations without reservations, minimum service and quality limits, whose dependencies stay within their resource.
    """
    limits = resources.select("resource_id", "capacity", "interval_ticks", "max_overlap")
    rows = flows.join(priorities.select("priority_id", "rank"), "priority_id").join(limits, "resource_id")
    names = ["flow_id", "resource_id", "estimated_work", "service_quantum", "release_tick", "deadline_tick", "weight", "rank", "fairness_group", "dependencies", "capacity", "interval_ticks", "max_overlap"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        return _steps(frame, int(first["capacity"]), int(first["interval_ticks"]), int(first["max_overlap"]), policy, step, len(ticks) if ticks else rounds, ticks)

    return rows.select(*names).groupBy("resource_id").applyInPandas(run, SIMULATED)
