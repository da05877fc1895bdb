"""Policies, digests, the journal, completion and the stream."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from sluice import policy
from sluice.functions import digests, scalars
from sluice.operators import completion
from sluice.sources import derived, journal
from sluice.streaming import completions

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("change", "code"),
    [({}, "ok"), ({"policy_id": 0}, "invalid-argument"), ({"max_flows": 0}, "out-of-range"), ({"max_quantum": 1 << 41}, "out-of-range"), ({"retained_schedule_history": 15}, "out-of-range"), ({"preemption": "maybe"}, "invalid-argument"), ({"provenance": "unknown"}, "invalid-argument")],
)
def test_policy_rules(change, code):
    assert policy.validate(dataclasses.replace(policy.Policy(), **change))[0] == code


def test_policy_succession():
    first = policy.Policy()
    assert policy.install(None, first)[0] == "ok"
    assert policy.install(first, first)[0] == "invalid-argument"
    assert policy.install(first, dataclasses.replace(first, generation=2))[0] == "ok"
    assert policy.install(first, dataclasses.replace(first, generation=2, max_flows=5), flows=6)[0] == "bound-exceeded"


def test_crc32c_vectors(spark):
    assert digests.crc32c_of(b"123456789") == 0xE3069283
    assert digests.crc32c_of(bytes(32)) == 0x8A9136AA
    got = spark.createDataFrame([(b"123456789",), (b"",)], "d binary").select(digests.crc32c("d").alias("c")).collect()
    assert [r["c"] for r in got] == [0xE3069283, 0]


def test_fnv_of_fields(spark):
    def plain(*values):
        state = digests.FNV_OFFSET
        for v in values:
            for b in (v & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"):
                state = ((state ^ b) * digests.FNV_PRIME) % (1 << 64)
        return state - (1 << 64) if state >> 63 else state

    got = spark.range(3).select(digests.fnv(F.col("id"), F.lit(7), F.lit(None)).alias("d")).collect()
    assert [r["d"] for r in got] == [plain(k, 7, 0) for k in range(3)]


def test_splitmix_is_fair_and_repeats():
    a, b = digests.SplitMix(9), digests.SplitMix(9)
    assert [a.below(10) for _ in range(50)] == [b.below(10) for _ in range(50)]
    assert digests.SplitMix(0).next() == 0xE220A8397B1DCDAF


def test_saturating_and_bounded(spark):
    row = spark.range(1).select(scalars.saturating_add(F.lit((1 << 63) - 2), F.lit(5)).alias("a"), scalars.bounded_detail(F.lit("a\tb" * 1000)).alias("d"), scalars.ticks_between(F.lit(9), F.lit(4)).alias("t"), scalars.stamp_cost(F.lit(4).cast("long"), F.lit(3).cast("long")).alias("s")).first()
    assert row["a"] == (1 << 63) - 1 and len(row["d"]) == 2048 and row["d"].endswith("...") and "\t" not in row["d"]
    assert row["t"] == 0 and row["s"] == (4 << 20) // 3


def test_journal_round_trip_and_tails(spark, tmp_path):
    records = [(5, "flow-admitted", b"a"), (6, "epoch-advanced", b""), (7, "checkpoint", b"xyz" * 99)]
    raw = journal.encode(records)
    assert journal.decode(raw) == (records, "clean")
    assert journal.decode(raw[:-2]) == (records[:2], "torn")
    assert journal.decode(raw[:40] + b"?" + raw[41:])[1] == "corrupt"
    assert journal.decode(journal.encode([records[0], records[2]]))[1] == "gap"
    (tmp_path / "a.log").write_bytes(raw)
    (tmp_path / "b.log").write_bytes(raw[:10])
    got = journal.scan(spark, str(tmp_path)).collect()
    assert sorted(r["sequence"] or 0 for r in got) == [0, 5, 6, 7] and {r["tail"] for r in got} == {"clean", "torn"}


ATTEMPT = "attempt_id long, flow_id long, schedule_id long, schedule_generation long, worker long, boot long, state string, quantum long, deadline_tick long, evidence_served long, credited long, evidence_digest string"
EVIDENCE = "sequence long, attempt_id long, epoch long, schedule_id long, schedule_generation long, flow_id long, flow_generation long, worker long, boot long, outcome string, served long, tick long, origin string"
FLOW = "flow_id long, generation long, open_attempt long, served_work long, estimated_work long"


def report(sequence, attempt=10, epoch=3, worker=1, boot=1, outcome="served", served=4, tick=9, generation=1):
    return (sequence, attempt, epoch, 1, 1, attempt // 10, generation, worker, boot, outcome, served, tick, "external")


def tables(spark):
    attempts = spark.createDataFrame([(10, 1, 1, 1, 1, 1, "open", 8, 100, None, 0, None), (20, 2, 1, 1, 1, 1, "started", 8, None, None, 0, None)], ATTEMPT)
    return attempts, spark.createDataFrame([(1, 1, 10, 0, 4), (2, 1, 20, 0, 16)], FLOW)


@pytest.mark.parametrize(
    ("change", "now", "code"),
    [({}, 50, "ok"), ({"epoch": 2}, 50, "stale-epoch"), ({"boot": 2}, 50, "fenced"), ({"generation": 2}, 50, "stale-flow-generation"), ({"attempt": 11}, 50, "unknown-attempt"), ({"served": 9}, 50, "contradictory-completion"), ({}, 100, "deadline-passed"), ({}, 99, "ok"), ({"outcome": "no-service"}, 200, "ok"), ({"worker": 0}, 50, "invalid-argument")],
)
def test_completion_codes(spark, change, now, code):
    attempts, flows = tables(spark)
    evidence = spark.createDataFrame([report(1, **change)], EVIDENCE)
    assert completion.dispositions(evidence, attempts, flows, 3, now).first()["code"] == code


def test_duplicates_within_a_batch(spark):
    attempts, flows = tables(spark)
    evidence = spark.createDataFrame([report(1), report(2), report(3, served=5)], EVIDENCE)
    got = sorted(completion.dispositions(evidence, attempts, flows, 3, 50).collect(), key=lambda r: r["sequence"])
    assert [r["code"] for r in got] == ["ok", "duplicate-completion", "contradictory-completion"]
    assert got[0]["lifecycle_after"] == "completed" and [r["credited"] for r in got] == [4, 4, 0]


def test_stream_answers_each_report_once(spark, tmp_path):
    attempts, flows = tables(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(([report(1)], [report(2), report(3, attempt=20)], [report(4, attempt=20, served=5)])):
        spark.createDataFrame(rows, EVIDENCE).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(EVIDENCE).option("recursiveFileLookup", "true").parquet(source)
        completions.start(stream, attempts, flows, out, str(tmp_path / "checkpoint"), 3, 50).awaitTermination()
    got = {r["sequence"]: r["code"] for r in completions.answers(spark, out).collect()}
    assert got == {1: "ok", 2: "duplicate-completion", 3: "ok", 4: "contradictory-completion"}


def test_answers_are_the_same_for_any_split_into_batches(spark, tmp_path):
    attempts, flows = tables(spark)
    rows = [report(1, served=9), report(2), report(3, outcome="failed"), report(4, tick=10), report(5), report(6, attempt=20, served=3), report(7, attempt=20, served=3, tick=8), report(8, attempt=20, served=3), report(9, boot=2)]
    want = {r["sequence"]: (r["code"], r["credited"]) for r in completion.dispositions(spark.createDataFrame(rows, EVIDENCE), attempts, flows, 3, 50).collect()}
    assert [want[k][0] for k in range(1, 10)] == ["contradictory-completion", "ok", *["contradictory-completion"] * 2, "duplicate-completion", "ok", "contradictory-completion", "duplicate-completion", "fenced"]
    for n, cuts in enumerate(([1, 2, 3, 4, 5, 6, 7, 8], [2, 6], [4, 7])):
        out = str(tmp_path / f"out{n}")
        for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            for _ in range(1 + (number == 1)):  # one batch is run twice
                completions.commit_batch(spark.createDataFrame(rows[a:b], EVIDENCE), number, attempts, flows, out, 3, 50)
        assert {r["sequence"]: (r["code"], r["credited"]) for r in completions.answers(spark, out).collect()} == want


def test_views_are_kept_within_a_scope(spark):
    assert derived.tables(spark, DATA) is not derived.tables(spark, DATA)
    with derived.kept(spark, DATA) as views:
        assert views is derived.tables(spark, DATA)
        assert views.flows.count() == 1500 and views.state.count() < 1500 and views.flows.is_cached
        flows = views.flows
    assert not flows.is_cached and derived.tables(spark, DATA) is not views
