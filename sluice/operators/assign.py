"""Service windows: who of the ranked candidates runs, with how much, and why not the others.

Without bound reservations and displacement a resource's candidates, taken in
order, get what is left of its capacity, which is a prefix sum; the overlap
ceiling is a prefix count.  Both are window aggregates over one partitioning by
resource (`closed_form`).  Where a reservation is shared or an incumbent may be
displaced, each step depends on the last; then every resource is folded in
order (`fold`), resources in parallel.  They are independent of each other but
for the entry limit and the displacement throttle, which cut the order of all at
one key each (`arbitrate.decide`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scalars import div, first_match, ticks_between
from sluice.operators import ranking
from sluice.policy import Policy

c = F.col


def wanted(policy: Policy, now: int) -> Column:
    """What a candidate may get whatever the others do."""
    qos = F.when(c("max_service_per_dispatch") > 0, c("max_service_per_dispatch"))
    slack = ticks_between(F.lit(now), c("deadline_tick")) if policy.strict_deadlines else F.lit(None).cast("long")
    return F.least(c("service_quantum"), F.greatest(c("estimated_work") - c("served_work"), F.lit(0)), F.lit(policy.max_quantum), qos, slack)


def capacity_left(now: int) -> Column:
    """Capacity of the running interval that is not yet charged; a new interval starts empty."""
    same = c("interval_index") == div(F.lit(now).cast("long"), c("interval_ticks"))
    return F.when(F.coalesce(same, F.lit(False)), F.greatest(c("capacity") - c("reserved_this_interval"), F.lit(0))).otherwise(c("capacity"))


def closed_form(candidates: DataFrame) -> DataFrame:
    """candidates with grant and decision, where nothing is displaced and no reservation is shared.

    Needs want, capacity_left, in_flight, max_overlap and refusal (the reason when the ceiling is reached) beside the key.
    """
    before = Window.partitionBy("resource_id").orderBy(*ranking.ordering()).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.sum("want").over(before), F.lit(0))
    rows = candidates.withColumn("grant", F.greatest(F.least(c("want"), c("capacity_left") - asked), F.lit(0)))
    rows = rows.withColumn("_rank", F.coalesce(F.sum((c("grant") > 0).cast("long")).over(before), F.lit(0)))
    full = c("_rank") >= F.greatest(c("max_overlap") - c("in_flight"), F.lit(0))
    reason = first_match([(full, c("refusal")), (c("grant") > 0, "selected"), (c("want") == 0, "no-legal-quantum")], "resource-capacity-exhausted")
    return rows.withColumn("decision", reason).withColumn("grant", F.when(c("decision") == "selected", c("grant")).otherwise(F.lit(0))).drop("_rank")


def reservation_shares(candidates: DataFrame) -> DataFrame:
    """candidates of reservations with granted: what each gets of its reservation alone, in order."""
    before = Window.partitionBy("reservation_id").orderBy(*ranking.ordering()).rowsBetween(Window.unboundedPreceding, -1)
    left = c("reservation_left") - F.coalesce(F.sum("want").over(before), F.lit(0))
    return candidates.withColumn("granted", F.greatest(F.least(c("want"), left), F.lit(0)).cast("long"))


def incumbents(flows: DataFrame) -> DataFrame:
    """(resource_id, n, worst) of flows that hold an open attempt: how many, and the one last in the order."""
    held = flows.filter(c("open_attempt").isNotNull())
    worst = F.max_by(F.struct("flow_id", "generation", "open_attempt", "tier", "rank", "preemptible", "preemption_protected", "served_work", "deadline_tick"), ranking.order_struct())
    return held.groupBy("resource_id").agg(F.count("flow_id").alias("incumbents"), worst.alias("worst"))


def verdict(policy: Policy, now: int, spent: Column | int = 0) -> Column:
    """Whether a candidate (tier, rank) may displace the incumbent worst: null if so, else why not."""
    if policy.preemption == "none":
        return F.lit("preemption-disabled")
    w = c("worst")
    better, above = c("rank") < w["rank"], c("tier") < w["tier"]
    urgent = (c("tier") == 0) & (w["tier"] != 0)
    overdue = F.coalesce(w["deadline_tick"] <= now, F.lit(False))
    allowed = {"strict-priority": better | overdue, "deadline": urgent | overdue, "tiered": above | better | overdue}[policy.preemption]
    return first_match(
        [
            (F.coalesce(w["preemption_protected"], F.lit(False)), "incumbent-not-preemptible"),
            (~w["preemptible"], "incumbent-not-preemptible"),
            (w["served_work"] < policy.min_preempt_service, "preemption-throttled"),
            (F.lit(spent) >= policy.max_preemptions_per_interval, "preemption-throttled"),
            (~allowed, "preemption-not-authorized"),
        ],
        None,
    )


FOLDED = "flow_id long, grant long, decision string, victim long, victim_attempt long"


class _Resource:
    """What a pass over one resource's candidates keeps: its incumbents, the worst last, and what this round has placed."""

    def __init__(self) -> None:
        self.live: list = []
        self.placed = self.charged = 0
        self.booked: dict[int, int] = {}

    def decide(self, r, policy: Policy, now: int, until: tuple | None) -> tuple[int, str, object]:
        """(grant, decision, victim) of the next candidate in order."""
        victim = None
        if r.in_flight + self.placed >= r.max_overlap:
            if not self.live:
                return 0, "concurrency-limit-reached", None
            refusal = _refusal(r, self.live[-1], policy, now, until)
            if refusal:
                return 0, refusal, None
            victim = self.live.pop()
            self.placed -= 1
        room, bound = max(0, r.capacity_left - self.charged), not pd.isna(r.reservation_id)
        slack = max(0, int(r.reservation_left) - self.booked.get(int(r.reservation_id), 0)) if bound else room
        grant = int(min(r.want, room, slack))
        if grant == 0:
            left = r.estimated_work - r.served_work
            return 0, "no-legal-quantum" if left <= 0 else "resource-capacity-exhausted" if room == 0 else "reservation-exhausted" if slack == 0 else "no-legal-quantum", victim
        self.placed, self.charged = self.placed + 1, self.charged + grant
        if bound:
            self.booked[int(r.reservation_id)] = self.booked.get(int(r.reservation_id), 0) + grant
        return grant, "selected", victim


def key_of(r) -> tuple:
    """A row's place in the order as a comparable value."""
    return r.tier, r.rank, (1 << 63) - 1 if pd.isna(r.key_deadline) else int(r.key_deadline), r.key_stamp, -r.weight, r.flow_id, r.generation


def _refusal(r, w, policy: Policy, now: int, until: tuple | None) -> str | None:
    if policy.preemption == "none":
        return "preemption-disabled"
    if w.preemption_protected or not w.preemptible:
        return "incumbent-not-preemptible"
    if w.served_work < policy.min_preempt_service or (until is not None and key_of(r) > until):
        return "preemption-throttled"
    overdue = not pd.isna(w.deadline_tick) and w.deadline_tick <= now
    above, better = r.tier < w.tier, r.rank < w.rank
    urgent = r.tier == 0 and w.tier != 0
    allowed = {"strict-priority": better, "deadline": urgent, "tiered": above or better}[policy.preemption]
    return None if allowed or overdue else "preemption-not-authorized"


_FOLD_COLUMNS = ("resource_id", "kind", "flow_id", "generation", "tier", "rank", "key_deadline", "key_stamp", "weight", "want", "capacity_left", "in_flight", "max_overlap", "reservation_id", "reservation_left", "estimated_work", "served_work", "preemption_protected", "preemptible", "deadline_tick", "open_attempt")


def fold(candidates: DataFrame, held: DataFrame, policy: Policy, now: int, until: tuple | None = None) -> DataFrame:
    """The sequential pass over each resource, as rows of FOLDED; held are the incumbents.

    Every resource is one sorted stream, of which a task keeps the incumbents and a few sums, however many candidates there
    are.  until: the key of the last candidate that may displace (all may if it is None).
    """
    rows = candidates.withColumn("kind", F.lit(1)).withColumn("open_attempt", F.lit(None).cast("long"))
    for name in ("want", "capacity_left", "in_flight", "max_overlap", "reservation_left"):
        held = held.withColumn(name, F.lit(0).cast("long"))
    rows = held.withColumn("kind", F.lit(0)).select(*_FOLD_COLUMNS).unionByName(rows.select(*_FOLD_COLUMNS))
    rows = rows.fillna(False, ["preemption_protected", "preemptible"]).withColumn("_by", F.xxhash64("resource_id"))
    # dealt by a column that no join below is keyed on: a repartition that looks redundant is dropped, and adaptive execution may then undo what it relied on
    rows = rows.repartition("_by").sortWithinPartitions("resource_id", "kind", *ranking.ordering())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, _Resource()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.resource_id != at:
                    at, own = r.resource_id, _Resource()
                if r.kind == 0:
                    own.live.append(r)
                    continue
                grant, decision, victim = own.decide(r, policy, now, until)
                out.append((r.flow_id, grant, decision, victim and victim.flow_id, victim and int(victim.open_attempt)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FOLDED.split(", ")]).astype({"victim": "Int64", "victim_attempt": "Int64"})

    return rows.mapInPandas(run, FOLDED)
