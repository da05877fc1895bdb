"""The knobs of arbitration and the order in which they are validated."""

from __future__ import annotations

from dataclasses import dataclass

# Bounds of descriptors.
MAX_FLOWS, MAX_RESOURCES, MAX_RESERVATIONS, MAX_CLASSES = 1 << 20, 1 << 16, 1 << 18, 1 << 12
MAX_ENTRIES, MAX_DEPENDENCIES = 1 << 16, 4096
MAX_SERVICE, MAX_QUANTUM, MAX_TICK = 1 << 48, 1 << 40, 1 << 60
#: Entries that one journal record of 1 MiB can hold at 320 bytes each.
HARD_ENTRY_LIMIT = (1 << 20) // 320
MAX_DEFERRED, MAX_STEPS = 4096, 32
#: Scale of fair-queueing stamps.
STAMP_SHIFT = 20
MODES = ("none", "strict-priority", "deadline", "tiered")


@dataclass(frozen=True)
class Policy:
    policy_id: int = 1
    generation: int = 1
    max_flows: int = MAX_FLOWS
    max_resources: int = MAX_RESOURCES
    max_reservations: int = MAX_RESERVATIONS
    max_entries_per_schedule: int = MAX_ENTRIES
    max_quantum: int = MAX_QUANTUM
    default_max_overlap: int = 1
    starvation_bound_ticks: int = 1000
    deadline_urgency_ticks: int = 20
    min_preempt_service: int = 0
    preemption_interval_ticks: int = 1000
    max_preemptions_per_interval: int = 64
    dispatch_delivery_horizon: int = 100
    retained_schedule_history: int = 4096
    preemption: str = "tiered"
    strict_deadlines: bool = True
    deadline_ordering: bool = True
    weighted_fairness: bool = True
    min_service_guarantee: bool = True
    provenance: str = "external"
    #: A flow overdue while in flight is failed once it is back; the compat flag leaves it ready for good.
    fail_overdue_after_preemption: bool = True

    @property
    def entry_limit(self) -> int:
        return min(self.max_entries_per_schedule, HARD_ENTRY_LIMIT)


def validate(policy: Policy) -> tuple[str, str]:
    """(code, knob) of the first rule that the policy breaks, or ('ok', '')."""
    p = policy
    rules = (
        (p.policy_id <= 0, "invalid-argument", "id"),
        (p.generation <= 0, "invalid-argument", "generation"),
        (not 1 <= p.max_flows <= MAX_FLOWS, "out-of-range", "flows"),
        (not 1 <= p.max_resources <= MAX_RESOURCES, "out-of-range", "resources"),
        (not 1 <= p.max_reservations <= MAX_RESERVATIONS, "out-of-range", "reservations"),
        (not 1 <= p.max_entries_per_schedule <= MAX_ENTRIES, "out-of-range", "entries"),
        (not 1 <= p.max_quantum <= MAX_QUANTUM, "out-of-range", "quantum"),
        (not 1 <= p.default_max_overlap <= MAX_SERVICE, "out-of-range", "overlap"),
        (not 1 <= p.starvation_bound_ticks <= MAX_TICK, "out-of-range", "starvation"),
        (not 0 <= p.deadline_urgency_ticks <= MAX_TICK, "out-of-range", "urgency"),
        (not 0 <= p.min_preempt_service <= MAX_SERVICE, "out-of-range", "min-preempt"),
        (not 1 <= p.preemption_interval_ticks <= MAX_TICK, "out-of-range", "interval"),
        (not 0 <= p.max_preemptions_per_interval <= 1 << 24, "out-of-range", "throttle"),
        (not 1 <= p.dispatch_delivery_horizon <= MAX_TICK, "out-of-range", "horizon"),
        (not 16 <= p.retained_schedule_history <= 1 << 20, "out-of-range", "history"),
        (p.preemption not in MODES, "invalid-argument", "mode"),
        (p.provenance == "unknown", "invalid-argument", "provenance"),
    )
    return next(((code, message) for broken, code, message in rules if broken), ("ok", ""))


def install(current: Policy | None, new: Policy, flows: int = 0) -> tuple[str, str]:
    """Whether new may follow current: a new id starts at generation 1, the same id goes one generation on, and the flows present must fit."""
    found = validate(new)
    if found[0] != "ok":
        return found
    expected = current.generation + 1 if current and current.policy_id == new.policy_id else 1
    if new.generation != expected:
        return "invalid-argument", "succession"
    if new.max_flows < flows:
        return "bound-exceeded", "too-many-flows"
    return "ok", ""
