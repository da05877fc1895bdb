"""Hand-made rounds, and the closed form against the fold."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import arbitrate, readiness
from sluice.plans import rounds
from sluice.plans.world import world_of
from sluice.policy import Policy
from sluice.sources import derived
from sluice.sources.shared import written

#: State columns of the worlds here; the others are added as a round needs them.
STATE = ("lifecycle", "served_work", "outstanding_reserved", "open_attempt", "eligible_since_tick", "ever_ready", "min_service_window_start", "min_service_delivered", "virtual_finish", "deadline_missed_counted", "wait_ticks")
NONE = Policy(preemption="none", starvation_bound_ticks=1000, deadline_urgency_ticks=100)


def world(spark, flows, capacity=1_000_000, overlap=1, reservations=(), qos=((1, 1, False, 0),), in_flight=0, spent=0):
    """flows: dicts of what differs from the standard flow."""
    rows = []
    for k, f in enumerate(flows):
        base = dict.fromkeys([x.split()[0] for x in rounds.FLOW_SCHEMA.split(", ")], 1)
        base |= {"flow_id": k + 1, "reservation_id": None, "reservation_generation": None, "estimated_work": 4, "min_service": 0, "min_service_window": 0, "release_tick": 0, "deadline_tick": None, "preemptible": True, "auto_ready": True, "readiness_signal": 0, "dependencies": []}
        rows.append(base | {k: v for k, v in rounds.STATE.items() if k in STATE} | f)
    schema = rounds.FLOW_SCHEMA + ", lifecycle string, served_work long, outstanding_reserved long, open_attempt long, eligible_since_tick long, ever_ready boolean, min_service_window_start long, min_service_delivered long, virtual_finish long, deadline_missed_counted boolean, wait_ticks long"
    names = [x.split()[0] for x in schema.split(", ")]
    resources = spark.createDataFrame([(1, 1, capacity, 1000, overlap, in_flight, -1, 0), (2, 1, capacity, 1000, overlap, 0, -1, 0)], "resource_id long, generation long, capacity long, interval_ticks long, max_overlap long, in_flight long, interval_index long, reserved_this_interval long")
    held = spark.createDataFrame(list(reservations), "reservation_id long, generation long, resource_id long, window_begin long, window_end long, capacity long, reserved_units long, retired boolean, exclusive boolean")
    priorities = spark.createDataFrame([(k, 1, k - 1, 1) for k in range(1, 5)], "priority_id long, generation long, rank long, weight long")
    classes = spark.createDataFrame(list(qos), "qos_id long, generation long, preemption_protected boolean, max_service_per_dispatch long")
    return arbitrate.World(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), resources, held, priorities, classes, spent)


def decide(w, policy, now, **more):
    rows = arbitrate.round_decisions(w, policy, now, **more).collect()
    return {r["flow_id"]: (r["decision"], r["grant"], r["victim"]) for r in rows}


def test_urgency_beats_rank_and_ceiling(spark):
    got = decide(world(spark, [{"priority_id": 4, "deadline_tick": 50}, {"priority_id": 1}]), NONE, 0)
    assert got == {1: ("selected", 1, None), 2: ("concurrency-limit-reached", 0, None)}


def test_slack_clamps_the_quantum(spark):
    assert decide(world(spark, [{"deadline_tick": 20, "service_quantum": 64, "estimated_work": 64}]), NONE, 0)[1] == ("selected", 20, None)


def test_capacity_is_shared_in_order(spark):
    w = world(spark, [{"service_quantum": 4}, {"service_quantum": 4}], capacity=4, overlap=4)
    assert decide(w, NONE, 0) == {1: ("selected", 4, None), 2: ("resource-capacity-exhausted", 0, None)}


def test_reservation_window(spark):
    w = world(spark, [{"reservation_id": 1, "reservation_generation": 1}], reservations=[(1, 1, 1, 100, 200, 8, 0, False, False)])
    assert [decide(w, NONE, t)[1][0] for t in (0, 150, 200)] == ["awaiting-reservation-window", "selected", "reservation-window-closed"]


def test_exclusive_window_keeps_others_out(spark):
    w = world(spark, [{}], reservations=[(1, 1, 1, 100, 200, 8, 0, False, True)])
    assert [decide(w, NONE, t)[1][0] for t in (150, 900)] == ["awaiting-reservation-window", "selected"]


def test_shared_reservation_is_folded(spark):
    bound = {"reservation_id": 1, "reservation_generation": 1, "service_quantum": 4}
    w = world(spark, [bound, bound, bound], overlap=4, reservations=[(1, 1, 1, 0, 200, 6, 0, False, False)])
    assert decide(w, NONE, 10) == {1: ("selected", 4, None), 2: ("selected", 2, None), 3: ("reservation-exhausted", 0, None)}


def test_minimum_service_goes_first(spark):
    w = world(spark, [{}, {"min_service": 4, "min_service_window": 100}])
    assert decide(w, NONE, 0)[2][0] == "selected"


def test_missed_deadline_and_failed_dependency(spark):
    w = world(spark, [{"lifecycle": "failed"}, {"dependencies": [1]}, {"deadline_tick": 5}, {"dependencies": [99]}])
    got = decide(w, NONE, 10)
    assert [got[k][0] for k in (2, 3, 4)] == ["dependency-failed", "deadline-missed", "awaiting-dependency"]


@pytest.mark.parametrize(
    ("change", "policy", "want"),
    [
        ({}, Policy(deadline_urgency_ticks=0), "selected"),
        ({"preemptible": False}, Policy(deadline_urgency_ticks=0), "incumbent-not-preemptible"),
        ({}, Policy(deadline_urgency_ticks=0, min_preempt_service=5), "preemption-throttled"),
        ({}, Policy(deadline_urgency_ticks=0, max_preemptions_per_interval=0), "preemption-throttled"),
        ({"priority_id": 1}, Policy(deadline_urgency_ticks=0), "preemption-not-authorized"),
        ({}, Policy(preemption="none"), "preemption-disabled"),
    ],
)
def test_displacement(spark, change, policy, want):
    held = {"priority_id": 4, "lifecycle": "running", "open_attempt": 77} | change
    got = decide(world(spark, [held, {"priority_id": 1}], in_flight=1), policy, 0)
    assert got[2] == ((want, 1, 1) if want == "selected" else (want, 0, None))


@pytest.mark.parametrize("seed", range(6))
def test_closed_form_equals_fold(spark, seed):
    draw = random.Random(seed)
    flows = [{"priority_id": draw.randint(1, 4), "resource_id": draw.randint(1, 2), "service_quantum": draw.randint(1, 9), "estimated_work": draw.randint(1, 20), "deadline_tick": draw.choice([None, 5, 40]), "weight": draw.randint(1, 4), "virtual_finish": draw.randint(0, 9), "lifecycle": draw.choice(["waiting", "ready"])} for _ in range(40)]
    w = world(spark, flows, capacity=draw.randint(5, 60), overlap=draw.randint(1, 12), in_flight=draw.randint(0, 3))
    limited = Policy(preemption="none", max_entries_per_schedule=draw.randint(1, 30))
    for policy in (NONE, limited):
        assert decide(w, policy, 3, exact_fold=False) == decide(w, policy, 3, exact_fold=True)


def test_iterated_rounds_equal_the_simulation(spark):
    """A hundred seeded populations side by side, each on a resource of its own, by rounds that are shorter than an interval."""
    w, rows = world(spark, [{}]), []
    for seed in range(100):
        for r in rounds.drawn(10, seed, dependencies=0.3, overlap=3, capacity=9, work=4):
            late = r["deadline_tick"] and r["deadline_tick"] % 2600 + 200
            rows.append(r | {"flow_id": r["flow_id"] + 1000 * seed, "dependencies": [d + 1000 * seed for d in r["dependencies"]], "resource_id": seed + 1, "fairness_group": r["fairness_group"] + 10 * seed, "deadline_tick": late})
    flows = spark.createDataFrame([tuple(r.values()) for r in rows], rounds.FLOW_SCHEMA)
    resources = spark.createDataFrame([(k + 1, 1, 9, 1000, 3, 0, -1, 0) for k in range(100)], w.resources.schema)
    ticks = [0, 400, 1100, 1300]
    after = rounds.iterate(arbitrate.World(flows, resources, w.reservations, w.priorities, w.qos), NONE, ticks)
    simulated = rounds.simulate(rounds.completed_state(flows), resources, w.priorities, NONE, ticks=ticks)
    pick = lambda frame: {r["flow_id"]: (r["lifecycle"], r["served_work"]) for r in frame.select("flow_id", "lifecycle", "served_work").collect()}
    got, want = pick(after.flows), pick(simulated)
    assert got == want and {v[0] for v in got.values()} >= {"completed", "failed", "waiting"}


def flow_of(course, key):
    return course.world.flows.filter(F.col("flow_id") == key).first()


def test_capacity_is_charged_across_the_rounds_of_an_interval(spark):
    w = world(spark, [{"service_quantum": 4, "estimated_work": 40}], capacity=4, overlap=4)
    after = rounds.iterate(w, NONE, [0, 100, 1000])
    assert after.flows.first()["served_work"] == 8
    assert after.resources.filter("resource_id = 1").first()[-2:] == (1, 4)


def test_a_round_issues_entries_and_displaces(spark):
    policy = Policy(deadline_urgency_ticks=0, max_preemptions_per_interval=1)
    held = {"priority_id": 4, "lifecycle": "running", "open_attempt": 77, "outstanding_reserved": 3, "served_work": 1}
    course = rounds.begin(world(spark, [held, held | {"open_attempt": 78}, {"priority_id": 1}, {"priority_id": 1}], overlap=2, in_flight=2))
    course, told = rounds.run_round(course, policy, 10)
    entries = [(r["ordinal"], r["kind"], r["flow_id"], r["attempt_id"], r["quantum"], r["tier"], r["reason"]) for r in told.entries.orderBy("ordinal").collect()]
    assert entries == [(0, "preempt", 2, 78, 3, 3, "displaced-by-higher-authority"), (1, "run", 3, None, 1, 3, "selected")]
    assert {r["flow_id"]: r["decision"] for r in told.decisions.collect()}[4] == "preemption-throttled"
    victim = flow_of(course, 2)
    assert (victim["lifecycle"], victim["open_attempt"], victim["outstanding_reserved"], victim["preemptions"], victim["eligible_since_tick"]) == ("ready", None, 0, 1, 10)
    assert victim["virtual_finish"] >= flow_of(course, 3)["virtual_finish"]  # stamped after the clock has moved
    assert flow_of(course, 3)["lifecycle"] == "scheduled" and course.world.spent == 1 and course.next_schedule == 2
    assert course.world.resources.filter("resource_id = 1").first()["in_flight"] == 2
    with pytest.raises(ValueError, match="invalid-argument"):
        rounds.run_round(course, policy, 9)
    course, told = rounds.run_round(course, policy, 1010)  # a new interval of the throttle; the window of flow 3 goes back first
    assert [r["flow_id"] for r in told.reclaimed.collect()] == [3]
    assert told.displaced == 1 and {r["flow_id"] for r in told.entries.filter("kind = 'run'").collect()} == {2, 4}  # flow 2 has waited long enough to go before flow 3


def test_overdue_work_is_stopped_and_fails_once_it_is_back(spark):
    held = {"lifecycle": "running", "open_attempt": 5, "deadline_tick": 100, "outstanding_reserved": 2, "served_work": 1}
    course = rounds.begin(world(spark, [held, {"dependencies": [1]}, {}], in_flight=1))
    course, told = rounds.run_round(course, NONE, 100)
    assert [r["flow_id"] for r in told.missed.collect()] == [1] and flow_of(course, 1)["lifecycle"] == "ready" and flow_of(course, 1)["preemptions"] == 1
    assert {r["flow_id"] for r in told.entries.collect()} == {3}  # the slot that the overdue flow held is free in the same round
    course, told = rounds.run_round(course, NONE, 101)
    assert flow_of(course, 1)["lifecycle"] == "failed" and told.missed.count() == 0
    course, _ = rounds.run_round(course, NONE, 102)
    assert flow_of(course, 2)["lifecycle"] == "failed"
    kept = rounds.begin(world(spark, [held, {}], in_flight=1))
    lenient = Policy(preemption="none", fail_overdue_after_preemption=False)
    for now in (100, 101):
        kept, _ = rounds.run_round(kept, lenient, now)
    assert flow_of(kept, 1)["lifecycle"] == "ready"


def test_failures_cascade_to_higher_ids_within_the_round(spark):
    flows = [{"deadline_tick": 5}, {"dependencies": [1]}, {"dependencies": [2]}, {"dependencies": [5]}, {"dependencies": [3]}]
    course = rounds.begin(world(spark, flows))
    course, told = rounds.run_round(course, NONE, 10)
    assert {r["flow_id"]: r["lifecycle"] for r in course.world.flows.collect()} == {1: "failed", 2: "failed", 3: "failed", 4: "waiting", 5: "failed"}
    assert not told.scheduled and course.next_schedule == 1  # nothing ran, so no schedule was issued
    cut, more = rounds.deferred(told, 0)
    assert more == (told.decisions.filter("decision <> 'selected'").count() > 0) and cut.count() == 0


def test_starvation_is_counted_once_an_episode(spark):
    course = rounds.begin(world(spark, [{"lifecycle": "running", "open_attempt": 9, "preemptible": False}, {"lifecycle": "ready", "ever_ready": True}], in_flight=1))
    for now in (1000, 1100):
        course, _ = rounds.run_round(course, NONE, now)
    assert flow_of(course, 2)["starvation_boosts"] == 1


def test_simulation_converges_and_books_close(spark):
    w = world(spark, [{}], capacity=64, overlap=8)
    flows = rounds.population(spark, 120, seed=3)
    out = rounds.simulate(flows, w.resources, w.priorities, NONE).toPandas()
    again = rounds.simulate(flows, w.resources, w.priorities, NONE).toPandas()
    assert out.equals(again) and len(out) == 120
    assert set(out["lifecycle"]) <= {"completed", "failed", "waiting"}
    work = {r["flow_id"]: r["estimated_work"] for r in flows.select("flow_id", "estimated_work").collect()}
    done = out[out["lifecycle"] == "completed"]
    assert (done["served_work"] == done["flow_id"].map(work)).all()


def test_recursive_cascade_follows_ascending_ids(spark):
    from sluice.operators import readiness

    w = world(spark, [{"lifecycle": "failed"}, {"dependencies": [1]}, {"dependencies": [2]}, {"dependencies": [5]}, {"dependencies": [1]}])
    assert {r["flow_id"]: r["depth"] for r in readiness.cascade(w.flows, 0).collect()} == {2: 1, 3: 2, 5: 1}
    assert w.flows.filter(F.col("flow_id") == 4).count() == 1  # its dependency fails, but has a higher id: next round


def test_a_round_derives_its_tables_once(spark):
    found = arbitrate.decide(world_of(derived.Tables(spark, "/root/testdata/sf0.001")), NONE, derived.NOW)
    assert found.inputFiles() and all("/sluice-" in name for name in found.inputFiles())


def test_only_ready_and_incumbent_flows_are_written(spark, monkeypatch):
    kept = []

    def write(frame, what):
        kept.append((what, written(frame, what)[0]))
        return kept[-1][1], ""

    monkeypatch.setattr(arbitrate, "written", write)
    w = world(spark, [{}, {"release_tick": 9}, {"lifecycle": "completed"}, {"dependencies": [3]}, {"dependencies": [2]}, {"lifecycle": "running", "open_attempt": 61}], overlap=9)
    assert decide(w, NONE, 0) == {1: ("selected", 1, None), 2: ("awaiting-release", 0, None), 4: ("selected", 1, None), 5: ("awaiting-dependency", 0, None)}
    assert sorted(r["flow_id"] for r in dict(kept)["candidates"].collect()) == [1, 4, 6]


def test_written_state_equals_the_join(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in derived.BASE:
        rows = spark.read.parquet(f"{source}/{name}.parquet")
        if name == "orders":  # an id that is there twice pairs with both states
            rows = rows.unionByName(rows.filter("o_orderkey < 3"))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    for folder in (source, str(tmp_path)):
        t = derived.Tables(spark, folder)
        want = t.state
        assert sorted(map(str, t.written_state(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_round_asks_one_gate_and_carries_what_deciding_reads(spark, monkeypatch):
    kept = {}

    def keep(df, what):
        kept.setdefault(what, []).append(set(df.columns))
        return written(df, what)

    monkeypatch.setattr(arbitrate, "written", keep)
    monkeypatch.setattr(readiness, "written", keep)
    small = world_of(derived.Tables(spark, "/root/testdata/sf0.001"))
    rows = arbitrate.round_decisions(small, NONE, derived.NOW)
    assert kept["candidates"] == [set(arbitrate.READ)] and len(kept["gate"]) == 1
    whole = arbitrate.decide(small, NONE, derived.NOW).select(*rows.columns)
    assert sorted(rows.collect(), key=str) == sorted(whole.collect(), key=str)
