"""Registered queries over readiness, order and assignment, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.scalars import div
from sluice.operators import arbitrate, assign, lifecycle, ranking, readiness
from sluice.plans import rounds
from sluice.plans.world import world_of
from sluice.policy import Policy
from sluice.sources.derived import DUCK, EPOCH, NOW, tables

c = F.col
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
POLICY = Policy(preemption="none")
TIERED = Policy()


def query(name: str, oracle: str | None = None):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: make(tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = f"{DUCK} {oracle}"
        return make

    return keep


GATE = """gate AS (SELECT flow_id, bool_and(coalesce(s.lifecycle = 'completed', false)) AS deps_met, bool_or(coalesce(s.lifecycle IN ('cancelled', 'failed'), false)) AS deps_failed
    FROM (SELECT f.flow_id, unnest(dependencies) AS dep FROM flows f JOIN flow_state USING (flow_id)) d LEFT JOIN flow_state s ON s.flow_id = d.dep GROUP BY d.flow_id)"""
GATE = GATE.replace("SELECT flow_id, bool_and", "SELECT d.flow_id, bool_and")
RES = f"""CASE WHEN r.reservation_id IS NULL OR r.retired THEN 'reservation-window-closed' WHEN r.generation <> f.reservation_generation THEN 'reservation-window-closed' WHEN r.resource_id <> f.resource_id THEN 'reservation-window-closed'
    WHEN {NOW} < r.window_begin THEN 'awaiting-reservation-window' WHEN {NOW} >= r.window_end THEN 'reservation-window-closed' WHEN r.reserved_units >= r.capacity THEN 'reservation-exhausted' END"""
EXCLUDED = f"(SELECT DISTINCT resource_id FROM reservations WHERE NOT retired AND exclusive AND {NOW} >= window_begin AND {NOW} < window_end)"
READY = f""", {GATE}, readied AS (SELECT f.*, s.* EXCLUDE (flow_id), r.capacity AS res_capacity, r.reserved_units AS res_used, CASE WHEN lifecycle IN ('completed', 'cancelled', 'failed') THEN 'terminal' WHEN lifecycle = 'ambiguous' THEN 'ambiguous-requires-resolution'
    WHEN lifecycle = 'waiting' AND {NOW} < release_tick THEN 'awaiting-release' WHEN readiness_signal = 2 OR (NOT auto_ready AND readiness_signal <> 1) THEN 'awaiting-readiness-signal' WHEN {NOW} < release_tick THEN 'awaiting-release'
    WHEN NOT deps_met AND deps_failed THEN 'dependency-failed' WHEN NOT deps_met THEN 'awaiting-dependency' WHEN f.reservation_id IS NULL AND f.resource_id IN {EXCLUDED} THEN 'awaiting-reservation-window'
    WHEN f.reservation_id IS NOT NULL AND {RES} IS NOT NULL THEN {RES} WHEN deadline_tick <= {NOW} THEN 'deadline-missed' ELSE 'selected' END AS reason
    FROM flows f JOIN flow_state s USING (flow_id) LEFT JOIN gate g USING (flow_id) LEFT JOIN reservations r ON r.reservation_id = f.reservation_id)"""
TIER = f"""CAST(CASE WHEN deadline_tick IS NOT NULL AND greatest(deadline_tick - {NOW}, 0) <= 20 THEN 0 WHEN ever_ready AND {NOW} - eligible_since_tick >= 1000 THEN 1 WHEN min_service > 0 AND min_service_delivered < min_service THEN 2 ELSE 3 END AS INT)"""
KEYED = f"""{READY}, keyed AS (SELECT d.*, {TIER} AS tier, p.rank, q.preemption_protected, q.max_service_per_dispatch, least(service_quantum, greatest(estimated_work - served_work, 0), CASE WHEN max_service_per_dispatch > 0 THEN max_service_per_dispatch ELSE 1000000 END,
    CASE WHEN deadline_tick IS NULL THEN 1000000 ELSE greatest(deadline_tick - {NOW}, 0) END) AS want, c.capacity, c.max_overlap, CASE WHEN {NOW} // 30 = {NOW // 30} THEN greatest(c.capacity - c.resource_id % 20, 0) ELSE c.capacity END AS room,
    coalesce(n, 0) AS in_flight FROM readied d JOIN priority_classes p USING (priority_id) JOIN qos_classes q USING (qos_id) JOIN resources c ON c.resource_id = d.resource_id
    LEFT JOIN (SELECT resource_id, count(*) AS n FROM flows JOIN flow_state USING (flow_id) WHERE lifecycle IN ('running', 'scheduled') GROUP BY 1) i ON i.resource_id = d.resource_id)"""
ORDER = "tier, rank, deadline_tick NULLS LAST, virtual_finish, weight DESC, flow_id, generation"
#: Candidates in order, and the incumbents of each resource, the worst first.
CANDIDATES = f"""{KEYED}, cand AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {ORDER}) AS i, flow_id, resource_id, tier, rank, want, room, in_flight, max_overlap, reservation_id IS NOT NULL AS bound, greatest(res_capacity - res_used, 0) AS res_left, estimated_work - served_work AS undone FROM keyed WHERE reason = 'selected' AND lifecycle IN ('waiting', 'ready')),
    held AS MATERIALIZED (SELECT resource_id, flow_id, tier, rank, preemption_protected OR NOT preemptible AS safe, coalesce(deadline_tick <= {NOW}, false) AS overdue, outstanding_reserved,
        row_number() OVER (PARTITION BY resource_id ORDER BY tier DESC, rank DESC, coalesce(deadline_tick, 9223372036854775807) DESC, virtual_finish DESC, weight, flow_id DESC) AS place FROM keyed WHERE open_attempt IS NOT NULL)"""


def pass_sql(tiered: bool) -> str:
    """The sequential pass over all candidates, a step each: what every resource has placed, charged, booked and lost is a list by resource (25 of them, each with one reservation)."""
    none = "list_transform(range(25), lambda x: CAST(0 AS BIGINT))"
    put = lambda name, change: f"list_transform({name}, lambda x, k: CASE WHEN k = resource_id THEN x + {change} ELSE x END)"
    disabled = "" if tiered else "WHEN true THEN 'preemption-disabled' "
    refusal = f"CASE WHEN in_flight + placed[resource_id] < max_overlap THEN NULL WHEN worst IS NULL THEN 'concurrency-limit-reached' {disabled}WHEN safe THEN 'incumbent-not-preemptible' WHEN spent >= 64 THEN 'preemption-throttled' WHEN NOT (tier < worst_tier OR rank < worst_rank OR overdue) THEN 'preemption-not-authorized' END"
    return f"""{CANDIDATES}, step AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS flow_id, CAST(NULL AS BIGINT) AS resource_id, CAST(NULL AS INT) AS tier, CAST(0 AS BIGINT) AS g, '' AS decision, CAST(NULL AS BIGINT) AS victim, CAST(NULL AS BIGINT) AS victim_units, {none} AS placed, {none} AS charged, {none} AS booked, {none} AS lost, CAST(0 AS BIGINT) AS spent
        UNION ALL
        SELECT i, flow_id, resource_id, tier, g, decision, CASE WHEN out = 1 THEN worst END, CASE WHEN out = 1 THEN outstanding_reserved END, {put('placed', '(CASE WHEN g > 0 THEN 1 ELSE 0 END) - out')}, {put('charged', 'g')}, {put('booked', '(CASE WHEN bound THEN g ELSE 0 END)')}, {put('lost', 'out')}, spent + out
        FROM (SELECT *, coalesce(refusal, CASE WHEN g > 0 THEN 'selected' WHEN undone <= 0 THEN 'no-legal-quantum' WHEN free = 0 THEN 'resource-capacity-exhausted' WHEN bound AND slack = 0 THEN 'reservation-exhausted' ELSE 'no-legal-quantum' END) AS decision
            FROM (SELECT *, CASE WHEN refusal IS NULL THEN CAST(least(want, free, CASE WHEN bound THEN slack ELSE free END) AS BIGINT) ELSE 0 END AS g, CAST(CASE WHEN refusal IS NULL AND in_flight + placed[resource_id] >= max_overlap THEN 1 ELSE 0 END AS BIGINT) AS out
                FROM (SELECT *, {refusal} AS refusal, greatest(0, room - charged[resource_id]) AS free, greatest(0, res_left - booked[resource_id]) AS slack
                    FROM (SELECT c.*, s.placed, s.charged, s.booked, s.lost, s.spent, h.flow_id AS worst, h.tier AS worst_tier, h.rank AS worst_rank, h.safe, h.overdue, h.outstanding_reserved FROM step s JOIN cand c ON c.i = s.i + 1 LEFT JOIN held h ON h.resource_id = c.resource_id AND h.place = s.lost[c.resource_id] + 1)))))"""


PASS, TIERED_PASS = pass_sql(False), pass_sql(True)
#: Why the other open flows do not run.
REST = "SELECT flow_id, resource_id, tier, CAST(0 AS BIGINT) AS quantum, reason AS decision FROM keyed WHERE reason <> 'selected' AND lifecycle IN ('waiting', 'ready', 'ambiguous')"


def _keyed(t, policy=POLICY):
    return arbitrate.candidates(world_of(t), policy, NOW)


@query("arbitrate_round", f"{PASS} SELECT flow_id, resource_id, tier, g AS quantum, decision FROM step WHERE i > 0 UNION ALL {REST}")
def arbitrate_round(t):
    return arbitrate.round_decisions(world_of(t), POLICY, NOW).select("flow_id", "resource_id", "tier", c("grant").alias("quantum"), "decision")


@query("arbitrate_fold", f"{TIERED_PASS} SELECT flow_id, resource_id, tier, g AS quantum, decision, victim FROM step WHERE i > 0 UNION ALL SELECT *, NULL FROM ({REST})")
def arbitrate_fold(t):
    return arbitrate.round_decisions(world_of(t), TIERED, NOW).select("flow_id", "resource_id", "tier", c("grant").alias("quantum"), "decision", "victim")


@query("schedule_entries", f"""{TIERED_PASS}, e AS (SELECT i, 0 AS part, 'preempt' AS kind, victim AS flow_id, victim_units AS quantum, tier FROM step WHERE victim IS NOT NULL UNION ALL SELECT i, 1, 'run', flow_id, g, tier FROM step WHERE g > 0)
    SELECT row_number() OVER (ORDER BY i, part) - 1 AS ordinal, kind, flow_id, f.generation AS flow_generation, f.resource_id, f.reservation_id, CAST(quantum AS BIGINT) AS quantum, f.deadline_tick, tier, CASE kind WHEN 'run' THEN 'selected' ELSE 'displaced-by-higher-authority' END AS reason, CASE kind WHEN 'preempt' THEN s.open_attempt END AS attempt_id
    FROM e JOIN flows f USING (flow_id) JOIN flow_state s USING (flow_id)""")
def schedule_entries(t):
    world = world_of(t)
    made = rounds.schedule_entries(arbitrate.decide(world, TIERED, NOW), world.flows, 1, EPOCH, NOW)
    return made.select("ordinal", "kind", "flow_id", "flow_generation", "resource_id", "reservation_id", "quantum", "deadline_tick", "tier", "reason", "attempt_id")


@query("round_partition", f"{PASS} SELECT decision, count(*) AS flows, CAST(sum(quantum) AS BIGINT) AS quantum FROM (SELECT flow_id, g AS quantum, decision FROM step WHERE i > 0 UNION ALL SELECT flow_id, quantum, decision FROM ({REST})) GROUP BY decision")
def round_partition(t):
    rows = arbitrate.round_decisions(world_of(t), POLICY, NOW)
    return rows.groupBy("decision").agg(F.count_distinct("flow_id").alias("flows"), F.sum("grant").alias("quantum"))


@query("readiness", f"{READY} SELECT flow_id, lifecycle, reason FROM readied")
def readiness_(t):
    return readiness.classify(t.state, t.reservations, NOW).select("flow_id", "lifecycle", "reason")


@query("dependency_gate", f", {GATE} SELECT * FROM gate")
def dependency_gate(t):
    return readiness.dependency_gate(t.state, t.flow_state)


@query("dependency_cascade", f""", chain AS (SELECT f.flow_id, CASE WHEN f.flow_id > 1 AND f.flow_id % 3 <> 0 THEN f.flow_id - 1 END AS dep, release_tick, auto_ready, readiness_signal, lifecycle FROM flows f JOIN flow_state USING (flow_id)),
    e AS (SELECT flow_id, dep FROM chain WHERE dep IS NOT NULL AND lifecycle = 'waiting' AND release_tick <= {NOW} AND readiness_signal <> 2 AND (auto_ready OR readiness_signal = 1))
    SELECT flow_id, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT e.flow_id, 1 AS depth FROM e JOIN chain c ON c.flow_id = e.dep AND c.lifecycle IN ('cancelled', 'failed')
        UNION ALL SELECT f.flow_id, 2 FROM e f JOIN e ON e.flow_id = f.dep JOIN chain c ON c.flow_id = e.dep AND c.lifecycle IN ('cancelled', 'failed')) GROUP BY flow_id""")
def dependency_cascade(t):
    linked = F.when((c("flow_id") > 1) & (c("flow_id") % 3 != 0), F.array(c("flow_id") - 1)).otherwise(F.array().cast("array<bigint>"))
    return readiness.cascade(t.state.withColumn("dependencies", linked), NOW)


@query("exclusive_window_semi_join", f"SELECT flow_id, resource_id FROM flows WHERE reservation_id IS NULL AND resource_id IN {EXCLUDED}")
def exclusive_window_semi_join(t):
    return readiness.exclusive_windows(t.flows, t.reservations, NOW).select("flow_id", "resource_id")


@query("reservation_state", f"SELECT f.flow_id, f.reservation_id, coalesce({RES}, 'selected') AS reason FROM flows f LEFT JOIN reservations r ON r.reservation_id = f.reservation_id WHERE f.reservation_id IS NOT NULL")
def reservation_state(t):
    rows = readiness.with_reservation(t.flows.filter(c("reservation_id").isNotNull()), t.reservations)
    return rows.select("flow_id", "reservation_id", F.coalesce(readiness.reservation_reason(NOW), F.lit("selected")).alias("reason"))


@query("tier", f"SELECT flow_id, {TIER} AS tier FROM flows JOIN flow_state USING (flow_id)")
def tier(t):
    return t.state.select("flow_id", ranking.tier(POLICY, NOW).alias("tier"))


@query("order_key", f"{KEYED} SELECT flow_id, tier, rank, row_number() OVER (ORDER BY {ORDER}) AS position FROM keyed WHERE reason = 'selected'")
def order_key(t):
    return ranking.positions(_keyed(t).filter(c("reason") == "selected")).select("flow_id", "tier", "rank", "position")


@query("entry_limit_topk", f"{KEYED} SELECT flow_id, row_number() OVER (ORDER BY {ORDER}) AS position FROM keyed WHERE reason = 'selected' QUALIFY position <= 25")
def entry_limit_topk(t):
    return ranking.positions(_keyed(t).filter(c("reason") == "selected"), 25).select("flow_id", "position")


@query("fair_stamp", """, k AS (SELECT fairness_group, max(virtual_finish) AS clock FROM flows JOIN flow_state USING (flow_id) WHERE lifecycle = 'running' GROUP BY 1)
    SELECT flow_id, CAST(greatest(virtual_finish, coalesce(clock, 0)) + (least(service_quantum, 1099511627776) * 1048576) // weight AS BIGINT) AS stamp FROM flows JOIN flow_state USING (flow_id) LEFT JOIN k USING (fairness_group) WHERE lifecycle = 'waiting'""")
def fair_stamp(t):
    clocks = ranking.group_clocks(t.state.filter(c("lifecycle") == "running"))
    return ranking.fair_stamps(t.state.filter(c("lifecycle") == "waiting"), clocks, POLICY).select("flow_id", "stamp")


@query("group_clock", "SELECT fairness_group, max(virtual_finish) AS clock FROM flows JOIN flow_state USING (flow_id) WHERE lifecycle IN ('running', 'scheduled') GROUP BY 1")
def group_clock(t):
    return ranking.group_clocks(t.state.filter(c("lifecycle").isin("running", "scheduled")))


@query("min_service_window", f"""SELECT flow_id, CAST(CASE WHEN reset THEN {NOW} ELSE min_service_window_start END AS BIGINT) AS window_start, CAST(CASE WHEN reset THEN 0 ELSE min_service_delivered END AS BIGINT) AS delivered
    FROM (SELECT *, min_service > 0 AND (NOT ever_ready OR {NOW} < min_service_window_start OR {NOW} - min_service_window_start >= min_service_window) AS reset FROM flows JOIN flow_state USING (flow_id))""")
def min_service_window(t):
    start, delivered = ranking.min_service_window(NOW)
    return t.state.select("flow_id", start.cast("long").alias("window_start"), delivered.cast("long").alias("delivered"))


@query("quantum_clamp", f"{KEYED} SELECT flow_id, CAST(want AS BIGINT) AS want FROM keyed WHERE reason = 'selected'")
def quantum_clamp(t):
    return _keyed(t).filter(c("reason") == "selected").select("flow_id", c("want").cast("long").alias("want"))


@query("capacity_interval", f"""SELECT flow_id, resource_id, release_tick // interval_ticks AS interval_index, CAST(CASE WHEN release_tick // interval_ticks = {NOW} // interval_ticks THEN greatest(capacity - resource_id % 20, 0) ELSE capacity END AS BIGINT) AS left_at_release FROM flows JOIN resources USING (resource_id) WHERE release_tick >= 0""")
def capacity_interval(t):
    rows = t.flows.filter(c("release_tick") >= 0).select("flow_id", "resource_id", "release_tick").join(t.resources, "resource_id")
    index = div(c("release_tick"), c("interval_ticks"))
    same = index == div(F.lit(NOW).cast("long"), c("interval_ticks"))
    return rows.select("flow_id", "resource_id", index.alias("interval_index"), F.when(same, F.greatest(c("capacity") - c("resource_id") % 20, F.lit(0))).otherwise(c("capacity")).alias("left_at_release"))


@query("capacity_grant", f"{PASS} SELECT s.resource_id, CAST(sum(g) AS BIGINT) AS granted, CAST(max(room) AS BIGINT) AS room FROM step s JOIN cand USING (i) GROUP BY s.resource_id")
def capacity_grant(t):
    return _ready(t).groupBy("resource_id").agg(F.sum("grant").alias("granted"), F.max("capacity_left").alias("room"))


def _ready(t):
    return arbitrate.decide_ready(world_of(t), POLICY, NOW)


@query("overlap_ceiling", f"{PASS} SELECT s.resource_id, count(*) FILTER (decision = 'selected') AS running, CAST(max(greatest(max_overlap - in_flight, 0)) AS BIGINT) AS slots FROM step s JOIN cand USING (i) GROUP BY s.resource_id")
def overlap_ceiling(t):
    return _ready(t).groupBy("resource_id").agg(F.count_if(c("decision") == "selected").alias("running"), F.max(F.greatest(c("max_overlap") - c("in_flight"), F.lit(0))).alias("slots"))


@query("deferral_reason", f"{PASS} SELECT flow_id, decision AS reason FROM step WHERE i > 0 AND decision <> 'selected'")
def deferral_reason(t):
    return _ready(t).filter(c("decision") != "selected").select("flow_id", c("decision").alias("reason"))


@query("reservation_grant", f"""{KEYED}, n AS (SELECT flow_id, reservation_id, want, greatest(res_capacity - res_used, 0) AS have, row_number() OVER (PARTITION BY reservation_id ORDER BY {ORDER}) AS i FROM keyed WHERE reservation_id IS NOT NULL AND res_capacity IS NOT NULL)
    SELECT flow_id, reservation_id, CAST(greatest(0, least(want, have - coalesce(sum(want) OVER (PARTITION BY reservation_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS granted FROM n""")
def reservation_grant(t):
    rows = _keyed(t).filter(c("reservation_id").isNotNull() & c("_res_capacity").isNotNull())
    return assign.reservation_shares(rows).select("flow_id", "reservation_id", "granted")


WORST = f"{KEYED}, worst AS (SELECT * FROM keyed WHERE open_attempt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY tier DESC, rank DESC, coalesce(deadline_tick, 9223372036854775807) DESC, virtual_finish DESC, weight, flow_id DESC) = 1)"


@query("worst_incumbent", f"{WORST} SELECT resource_id, flow_id, open_attempt FROM worst")
def worst_incumbent(t):
    return assign.incumbents(_keyed(t)).select("resource_id", c("worst.flow_id").alias("flow_id"), c("worst.open_attempt").alias("open_attempt"))


VERDICT = f"""{WORST}, v AS (SELECT k.flow_id, w.flow_id AS victim, w.open_attempt, k.tier, CASE WHEN w.preemption_protected OR NOT w.preemptible THEN 'incumbent-not-preemptible'
    WHEN NOT (k.tier < w.tier OR k.rank < w.rank OR coalesce(w.deadline_tick <= {NOW}, false)) THEN 'preemption-not-authorized' ELSE 'allowed' END AS verdict FROM keyed k JOIN worst w USING (resource_id) WHERE k.reason = 'selected' AND k.open_attempt IS NULL)"""


@query("preemption_verdict", f"{VERDICT} SELECT flow_id, victim, verdict FROM v")
def preemption_verdict(t):
    rows = _keyed(t, TIERED)
    ready = rows.filter((c("reason") == "selected") & c("open_attempt").isNull()).join(assign.incumbents(rows), "resource_id")
    return ready.select("flow_id", c("worst.flow_id").alias("victim"), F.coalesce(assign.verdict(TIERED, NOW), F.lit("allowed")).alias("verdict"))


@query("preempt_pairs", f"{TIERED_PASS} SELECT victim AS flow_id, 'preempt' AS kind, flow_id AS by_flow FROM step WHERE victim IS NOT NULL UNION ALL SELECT flow_id, 'run', flow_id FROM step WHERE g > 0")
def preempt_pairs(t):
    made = arbitrate.round_decisions(world_of(t), TIERED, NOW)
    stop = made.filter(c("victim").isNotNull()).select(c("victim").alias("flow_id"), F.lit("preempt").alias("kind"), c("flow_id").alias("by_flow"))
    return stop.unionByName(made.filter(c("grant") > 0).select("flow_id", F.lit("run").alias("kind"), c("flow_id").alias("by_flow")))


@query("preemption_throttle", "SELECT tick // 1000 AS bucket, count(*) AS displaced, count(*) >= 64 AS exhausted FROM journal WHERE type = 'attempt-closed' GROUP BY 1")
def preemption_throttle(t):
    closed = t.journal.filter(c("type") == "attempt-closed")
    return closed.groupBy(div(c("tick"), F.lit(TIERED.preemption_interval_ticks).cast("long")).alias("bucket")).agg(F.count("sequence").alias("displaced")).withColumn("exhausted", c("displaced") >= TIERED.max_preemptions_per_interval)


@query("overdue_sweep", f"SELECT flow_id, open_attempt, NOT deadline_missed_counted AS newly_missed FROM flows JOIN flow_state USING (flow_id) WHERE open_attempt IS NOT NULL AND deadline_tick <= {NOW}")
def overdue_sweep(t):
    return lifecycle.overdue(t.state, NOW)


@query("delivery_reclaim", f"SELECT schedule_id, flow_id FROM entries JOIN flow_state USING (flow_id) WHERE kind = 'run' AND consumed = 0 AND at_tick + 100 <= {NOW} AND lifecycle = 'scheduled' AND scheduled_schedule = schedule_id")
def delivery_reclaim(t):
    return lifecycle.reclaim(t.state, t.entries, TIERED, NOW)


@query("apply_schedule", "SELECT resource_id, count(*) AS in_flight, CAST(sum(quantum) AS BIGINT) AS reserved, CAST(sum(CASE WHEN reservation_id IS NOT NULL THEN quantum ELSE 0 END) AS BIGINT) AS on_reservations FROM entries WHERE kind = 'run' GROUP BY resource_id")
def apply_schedule(t):
    by_resource, by_reservation = lifecycle.apply_schedule(t.entries)
    booked = by_reservation.select(c("reservation_id").alias("resource_id"), c("reserved").alias("_b"))  # a reservation has its resource's number here
    return by_resource.join(booked, "resource_id", "left").select("resource_id", "in_flight", "reserved", F.coalesce("_b", F.lit(0)).alias("on_reservations"))


@query("release_schedule", "SELECT schedule_id, count(*) AS released, CAST(sum(quantum) AS BIGINT) AS still_charged FROM entries JOIN flow_state USING (flow_id) WHERE kind = 'run' AND consumed = 0 AND lifecycle = 'scheduled' GROUP BY schedule_id")
def release_schedule(t):
    return lifecycle.release(t.entries, t.flow_state)


@query("retention", """, s AS (SELECT schedule_id AS position, bool_or(consumed = 1 AND schedule_id % 3 = 0) AS open FROM entries GROUP BY schedule_id), x AS (SELECT *, bool_and(NOT open) OVER (ORDER BY position) AS free, row_number() OVER (ORDER BY position) AS i, count(*) OVER () AS n FROM s)
    SELECT position, open, NOT (free AND i <= n - 16) AS kept FROM x""")
def retention(t):
    schedules = t.entries.groupBy(c("schedule_id").alias("position")).agg(F.bool_or((c("consumed") == 1) & (c("schedule_id") % 3 == 0)).alias("open"))
    return lifecycle.retained(schedules, 16)


@query("population")
def population(t):
    return rounds.population(t.spark, 500)


@query("round_simulation")
def round_simulation(t):
    limits = t.resources.filter(c("resource_id") == 1).withColumn("capacity", F.lit(64).cast("long")).withColumn("interval_ticks", F.lit(1000).cast("long"))
    return rounds.simulate(rounds.population(t.spark, 250), limits, t.priority_classes, Policy(starvation_bound_ticks=16_000, deadline_urgency_ticks=2_000, preemption="none"))
