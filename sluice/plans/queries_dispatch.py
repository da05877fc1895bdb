"""Registered queries over dispatch, completion, lifecycle, the books and the log, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import accounting, completion, dispatch, eventlog, explain, lifecycle, ranking, registry
from sluice.policy import Policy
from sluice.sources.derived import DUCK, EPOCH, NOW, fnv_sql, tables

c = F.col
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
POLICY = Policy(preemption="none")


def query(name: str, oracle: str | None = None):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: make(tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = f"{DUCK} {oracle}"
        return make

    return keep


TICKET = f"""CASE WHEN a.epoch <> {EPOCH} THEN 'stale-epoch' WHEN a.policy_generation <> 1 THEN 'stale-policy-generation' WHEN f.flow_id IS NULL THEN 'unknown-flow' WHEN f.generation <> a.flow_generation THEN 'stale-flow-generation'
    WHEN f.path_id <> a.path_id OR f.path_generation <> a.path_generation THEN 'stale-path-generation' WHEN c.resource_id IS NULL THEN 'unknown-resource' WHEN c.generation <> a.resource_generation THEN 'stale-resource-generation'
    WHEN p.priority_id IS NULL THEN 'unknown-policy' WHEN p.generation <> a.priority_generation THEN 'stale-priority-generation' WHEN q.qos_id IS NULL THEN 'unknown-policy' WHEN q.generation <> a.qos_generation THEN 'stale-qos-generation'
    WHEN a.reservation_id IS NOT NULL AND (r.reservation_id IS NULL OR r.retired) THEN 'reservation-closed' WHEN a.reservation_id IS NOT NULL AND r.generation <> a.reservation_generation THEN 'stale-reservation-generation'
    WHEN a.reservation_id IS NOT NULL AND NOT ({NOW} >= r.window_begin AND {NOW} < r.window_end) THEN 'reservation-closed' WHEN a.deadline_tick <= {NOW} THEN 'deadline-passed' ELSE 'ok' END"""
JOINED = "attempts a LEFT JOIN flows f ON f.flow_id = a.flow_id LEFT JOIN resources c ON c.resource_id = a.resource_id LEFT JOIN priority_classes p ON p.priority_id = a.priority_id LEFT JOIN qos_classes q ON q.qos_id = a.qos_id LEFT JOIN reservations r ON r.reservation_id = a.reservation_id"


def _validated(t):
    return dispatch.validate_tickets(t.attempts, t.flows, t.resources, t.priority_classes, t.qos_classes, t.reservations, POLICY, EPOCH, NOW)


@query("ticket_validate", f"SELECT attempt_id, {TICKET} AS status FROM {JOINED}")
def ticket_validate(t):
    return _validated(t).select("attempt_id", "status")


@query("revalidate", f"SELECT attempt_id, CASE WHEN attempt_id % 7 = 0 THEN 'contradictory-completion' ELSE {TICKET} END AS status FROM {JOINED}")
def revalidate(t):
    signed = _validated(t).withColumn("digest", dispatch.ticket_digest())
    changed = signed.withColumn("quantum", F.when(c("attempt_id") % 7 == 0, c("quantum") + 1).otherwise(c("quantum")))
    return dispatch.revalidate(changed).select("attempt_id", "status")


REQUESTS = "SELECT schedule_id * 100000 + ordinal + 1 AS request, schedule_id, CASE WHEN ordinal % 7 = 6 THEN 2 ELSE 1 END AS schedule_generation, CASE WHEN ordinal % 5 = 4 THEN ordinal + 1000 ELSE ordinal END AS ordinal, CASE WHEN flow_id % 19 = 0 THEN 0 ELSE flow_id % 8 + 1 END AS worker FROM entries"


@query("begin_dispatch", f""", x AS ({REQUESTS}), h AS (SELECT schedule_id, count(*) AS n FROM entries GROUP BY 1), s AS (SELECT x.request, x.schedule_id, x.ordinal, a.flow_id, CASE WHEN x.worker = 0 THEN 'invalid-argument' WHEN x.schedule_generation <> 1 THEN 'stale-schedule-generation'
    WHEN x.ordinal >= h.n THEN 'out-of-range' WHEN kind <> 'run' THEN 'invalid-argument' WHEN consumed <> 0 THEN 'invalid-state' WHEN g.flow_id IS NULL THEN 'unknown-flow' WHEN lifecycle <> 'scheduled' OR scheduled_schedule <> x.schedule_id THEN 'invalid-state' WHEN a.flow_generation <> 1 THEN 'stale-flow-generation' ELSE {TICKET} END AS status
    FROM x JOIN h USING (schedule_id) LEFT JOIN ({JOINED.replace('attempts a', 'entries a')}) ON a.schedule_id = x.schedule_id AND a.ordinal = x.ordinal LEFT JOIN flow_state g ON g.flow_id = a.flow_id)
    SELECT request, schedule_id, ordinal, flow_id, status, CASE WHEN status = 'ok' THEN 500000 + row_number() OVER (PARTITION BY status = 'ok' ORDER BY request) - 1 END AS attempt_id FROM s""")
def begin_dispatch(t):
    late = F.when(c("ordinal") % 5 == 4, c("ordinal") + 1000).otherwise(c("ordinal"))
    requests = t.entries.select((c("schedule_id") * 100_000 + c("ordinal") + 1).alias("request"), "schedule_id", F.when(c("ordinal") % 7 == 6, 2).otherwise(1).alias("schedule_generation"), late.alias("ordinal"), F.when(c("flow_id") % 19 == 0, F.lit(0)).otherwise(c("flow_id") % 8 + 1).alias("worker"), F.lit(1).alias("boot"))
    return dispatch.begin_dispatch(requests, t.entries, t.state, (t.flows, t.resources, t.priority_classes, t.qos_classes, t.reservations), POLICY, EPOCH, NOW, 500_000)


@query("worker_loss", """SELECT attempt_id, a.flow_id, 'abandoned' AS state, CASE WHEN open_attempt = attempt_id THEN 'waiting' ELSE lifecycle END AS lifecycle FROM attempts a LEFT JOIN flow_state USING (flow_id)
    WHERE state IN ('open', 'started') AND (worker = 3 AND boot = 2 OR worker = 5 AND boot = 1)""")
def worker_loss(t):
    lost = t.spark.range(1).select(F.inline(F.array(F.struct(F.lit(3).alias("worker"), F.lit(2).alias("boot")), F.struct(F.lit(5).alias("worker"), F.lit(1).alias("boot")))))
    return dispatch.worker_loss(t.attempts, t.flow_state, lost)


@query("retention_cascade", """, s AS (SELECT schedule_id, bool_or(consumed = 1 AND schedule_id % 3 = 0 AND schedule_id > 40) AS open FROM entries GROUP BY 1), x AS (SELECT *, bool_and(NOT open) OVER (ORDER BY schedule_id) AS free, row_number() OVER (ORDER BY schedule_id) AS i, count(*) OVER () AS n FROM s)
    SELECT attempt_id, schedule_id FROM attempts WHERE schedule_id NOT IN (SELECT schedule_id FROM x WHERE free AND i <= n - 16)""")
def retention_cascade(t):
    schedules = t.entries.groupBy(c("schedule_id").alias("position")).agg(F.bool_or((c("consumed") == 1) & (c("schedule_id") % 3 == 0) & (c("schedule_id") > 40)).alias("open"))
    return lifecycle.retained_attempts(t.attempts, lifecycle.retained(schedules, 16)).select("attempt_id", "schedule_id")


@query("mark_started", """, r AS (SELECT attempt_id * 2 AS report, attempt_id FROM attempts UNION ALL SELECT attempt_id * 2 + 1, attempt_id FROM attempts WHERE attempt_id % 3 = 0 UNION ALL SELECT 1, 999999999999)
    SELECT report, attempt_id, CASE WHEN state IS NULL THEN 'unknown-attempt' WHEN state NOT IN ('open', 'started') THEN 'completion-for-closed-attempt' ELSE 'ok' END AS status,
    coalesce(state = 'open' AND row_number() OVER (PARTITION BY attempt_id ORDER BY report) = 1, false) AS first FROM r LEFT JOIN attempts USING (attempt_id)""")
def mark_started(t):
    once = t.attempts.select((c("attempt_id") * 2).alias("report"), "attempt_id")
    again = t.attempts.filter(c("attempt_id") % 3 == 0).select((c("attempt_id") * 2 + 1).alias("report"), "attempt_id")
    ghost = t.spark.range(1).select(F.lit(1).cast("long").alias("report"), F.lit(999_999_999_999).cast("long").alias("attempt_id"))
    return dispatch.mark_started(once.unionByName(again).unionByName(ghost), t.attempts)


@query("abandon", """SELECT attempt_id, action, CASE WHEN state NOT IN ('open', 'started') AND action = 'preempt' THEN 'completion-for-closed-attempt' ELSE 'ok' END AS status,
    CASE WHEN state IN ('open', 'started') THEN CASE action WHEN 'preempt' THEN 'preempted' ELSE 'abandoned' END ELSE state END AS state, CASE WHEN state IN ('open', 'started') THEN CASE action WHEN 'preempt' THEN 'ready' ELSE 'ambiguous' END END AS lifecycle
    FROM (SELECT *, CASE WHEN attempt_id % 4 < 2 THEN 'preempt' ELSE 'abandon' END AS action FROM attempts)""")
def abandon(t):
    requests = t.attempts.select("attempt_id", F.when(c("attempt_id") % 4 < 2, "preempt").otherwise("abandon").alias("action"))
    return dispatch.close_attempts(t.attempts, requests)


@query("worker_evidence", "SELECT attempt_id, epoch, schedule_id, schedule_generation, flow_id, flow_generation, worker, boot, CASE WHEN attempt_id % 24 > 0 THEN 'served' ELSE 'no-service' END AS outcome, least(attempt_id % 24, quantum) AS served FROM attempts WHERE state IN ('open', 'started')")
def worker_evidence(t):
    return dispatch.worker_evidence(t.attempts.filter(c("state").isin("open", "started")).withColumn("asked", c("attempt_id") % 24))


SAME = "(attempt_id, epoch, schedule_id, schedule_generation, flow_id, flow_generation, worker, boot, outcome, served, tick, origin)"


@query("evidence_dedupe", f"SELECT sequence, attempt_id, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN row{SAME} = first_value(row{SAME}) OVER w THEN 'exact' ELSE 'contradictory' END AS kind FROM evidence WINDOW w AS (PARTITION BY attempt_id ORDER BY sequence)")
def evidence_dedupe(t):
    return completion.dedupe(t.evidence).select("sequence", "attempt_id", "kind")


ANSWERS = f""", j AS (SELECT e.*, s.flow_id AS known, s.open_attempt, s.served_work, f.estimated_work, a.attempt_id AS found, a.flow_id AS af, a.schedule_id AS asch, a.schedule_generation AS ag, a.worker AS aw, a.boot AS ab, a.state, a.quantum, a.deadline_tick, a.evidence_digest, a.credited AS acred
    FROM evidence e LEFT JOIN flow_state s ON s.flow_id = e.flow_id LEFT JOIN flows f ON f.flow_id = s.flow_id LEFT JOIN attempts a ON a.attempt_id = e.attempt_id),
    b AS (SELECT *, CASE WHEN origin = 'unknown' THEN 'invalid-argument' WHEN worker = 0 THEN 'invalid-argument' WHEN epoch <> {EPOCH} THEN 'stale-epoch' WHEN known IS NULL THEN 'unknown-flow' WHEN flow_generation <> 1 THEN 'stale-flow-generation'
        WHEN found IS NULL THEN 'unknown-attempt' WHEN af <> flow_id OR asch <> schedule_id THEN 'contradictory-completion' WHEN ag <> schedule_generation THEN 'stale-schedule-generation' WHEN aw <> worker OR ab <> boot THEN 'fenced'
        WHEN state NOT IN ('open', 'started') THEN CASE WHEN evidence_digest = digest AND state = 'committed' THEN 'duplicate-completion' WHEN evidence_digest = digest OR evidence_digest IS NULL THEN 'completion-for-closed-attempt' ELSE 'contradictory-completion' END
        WHEN open_attempt IS NULL OR open_attempt <> attempt_id THEN 'stale-attempt' END AS fails, CASE WHEN served > quantum THEN 'contradictory-completion' WHEN outcome = 'served' AND deadline_tick <= {NOW} THEN 'deadline-passed' END AS unfit FROM j),
    a1 AS (SELECT *, min(CASE WHEN fails IS NULL AND unfit IS NULL THEN sequence END) OVER (PARTITION BY attempt_id, fails IS NULL) AS applied FROM b),
    a2 AS (SELECT x.*, y.digest AS od FROM a1 x LEFT JOIN b y ON y.sequence = x.applied),
    a3 AS (SELECT *, CASE WHEN fails IS NOT NULL THEN fails WHEN sequence = applied THEN 'ok' WHEN sequence < applied OR applied IS NULL THEN unfit WHEN digest = od THEN 'duplicate-completion' ELSE 'contradictory-completion' END AS code FROM a2),
    a4 AS (SELECT sequence, attempt_id, flow_id, code, CASE code WHEN 'ok' THEN 'applied' WHEN 'duplicate-completion' THEN 'idempotent-duplicate' ELSE 'rejected' END AS disposition, CAST(CASE WHEN code = 'ok' OR code = 'duplicate-completion' AND fails IS NULL THEN CASE WHEN outcome = 'served' THEN served ELSE 0 END
        WHEN code = 'duplicate-completion' THEN acred ELSE 0 END AS BIGINT) AS credited, outcome, served_work, estimated_work FROM a3),
    answers AS (SELECT sequence, attempt_id, flow_id, disposition, code, credited, CASE WHEN code <> 'ok' THEN NULL WHEN outcome = 'failed' THEN 'failed' WHEN served_work + credited >= estimated_work THEN 'completed' ELSE 'waiting' END AS lifecycle_after FROM a4)"""


def _answers(t):
    return completion.dispositions(t.evidence, t.attempts, t.state, EPOCH, NOW)


@query("completion_disposition", f"{ANSWERS} SELECT * FROM answers")
def completion_disposition(t):
    return _answers(t)


@query("completion_commit", f"{ANSWERS} SELECT flow_id, CAST(any_value(served_work) + sum(credited) AS BIGINT) AS served_work, max(lifecycle_after) AS lifecycle, max(attempt_id) AS closed_attempt FROM answers JOIN flow_state USING (flow_id) WHERE disposition = 'applied' GROUP BY flow_id")
def completion_commit(t):
    return completion.commit(_answers(t), t.flow_state)


COUNTS = "count(*) AS completion_reports_received, count(*) FILTER (disposition = 'applied') AS completions_applied, count(*) FILTER (disposition = 'idempotent-duplicate') AS completions_duplicate, count(*) FILTER (disposition = 'rejected') AS completions_rejected"


@query("disposition_counts", f"{ANSWERS} SELECT {COUNTS} FROM answers")
def disposition_counts(t):
    return accounting.disposition_counts(_answers(t))


# -- lifecycle ---------------------------------------------------------------

STALE = "WHEN s.flow_id IS NULL THEN 'unknown-flow' WHEN r.g <> 1 THEN 'stale-flow-generation'"
ASKED = "(SELECT flow_id, CAST(CASE WHEN flow_id % 12 = 0 THEN 2 ELSE 1 END AS BIGINT) AS g FROM flows)"


def _asked(t):
    return t.flows.select("flow_id", F.when(c("flow_id") % 12 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("request_generation"))


@query("wait_ticks", f"SELECT flow_id, CAST(wait_ticks + CASE WHEN lifecycle = 'ready' THEN greatest({NOW} - eligible_since_tick, 0) ELSE 0 END AS BIGINT) AS wait_ticks FROM flow_state")
def wait_ticks(t):
    return t.flow_state.select("flow_id", lifecycle.wait_after(NOW).cast("long").alias("wait_ticks"))


@query("cancel_flow", f""", r AS {ASKED}, x AS (SELECT r.*, s.* EXCLUDE (flow_id), CASE {STALE} WHEN lifecycle = 'cancelled' THEN 'ok' WHEN lifecycle IN ('completed', 'failed') THEN 'invalid-state' ELSE 'ok' END AS status FROM r LEFT JOIN flow_state s USING (flow_id))
    SELECT flow_id, g AS request_generation, status, CASE WHEN acts THEN 'cancelled' ELSE lifecycle END AS lifecycle, acts AND open_attempt IS NOT NULL AS closes_attempt, acts AND lifecycle = 'scheduled' AS releases_window,
    CAST(CASE WHEN acts AND lifecycle = 'ready' THEN wait_ticks + greatest({NOW} - eligible_since_tick, 0) ELSE wait_ticks END AS BIGINT) AS wait_ticks FROM (SELECT *, coalesce(status = 'ok' AND lifecycle <> 'cancelled', false) AS acts FROM x)""")
def cancel_flow(t):
    out = lifecycle.cancel(t.state, _asked(t), NOW)
    return out.withColumn("releases_window", F.coalesce("releases_window", F.lit(False))).withColumn("wait_ticks", c("wait_ticks").cast("long"))


@query("readiness_signal", f""", r AS (SELECT flow_id, g, CAST(CASE WHEN flow_id % 6 = 0 THEN 2 ELSE 1 END AS INT) AS signal FROM {ASKED}), x AS (SELECT r.*, s.lifecycle, f.readiness_signal AS old, CASE {STALE} WHEN lifecycle IN ('completed', 'cancelled', 'failed') THEN 'invalid-state' ELSE 'ok' END AS status
    FROM r LEFT JOIN flow_state s USING (flow_id) LEFT JOIN flows f ON f.flow_id = s.flow_id) SELECT flow_id, status, CASE WHEN status = 'ok' THEN signal ELSE old END AS readiness_signal, coalesce(status = 'ok' AND signal <> old, false) AS changed FROM x""")
def readiness_signal(t):
    first = _asked(t).withColumn("sequence", F.lit(1)).withColumn("signal", F.lit(0))
    last = _asked(t).withColumn("sequence", F.lit(2)).withColumn("signal", F.when(c("flow_id") % 6 == 0, 2).otherwise(1))
    return lifecycle.signal_readiness(t.state, first.unionByName(last))


@query("resolve_ambiguous", f""", r AS (SELECT *, CASE WHEN flow_id % 2 = 0 THEN 'retry' ELSE 'abandon' END AS resolution FROM {ASKED}) SELECT flow_id, status, CASE WHEN status = 'ok' THEN CASE resolution WHEN 'retry' THEN 'waiting' ELSE 'failed' END ELSE lifecycle END AS lifecycle
    FROM (SELECT r.*, lifecycle, CASE {STALE} WHEN lifecycle <> 'ambiguous' THEN 'invalid-state' ELSE 'ok' END AS status FROM r LEFT JOIN flow_state s USING (flow_id))""")
def resolve_ambiguous(t):
    return lifecycle.resolve_ambiguous(t.state, _asked(t).withColumn("resolution", F.when(c("flow_id") % 2 == 0, "retry").otherwise("abandon")))


@query("retire_flow", f", r AS {ASKED} SELECT flow_id, g AS request_generation, CASE {STALE} WHEN lifecycle NOT IN ('completed', 'cancelled', 'failed') THEN 'invalid-state' ELSE 'ok' END AS status FROM r LEFT JOIN flow_state s USING (flow_id)")
def retire_flow(t):
    return registry.retire_flows(t.state, _asked(t))


@query("epoch_advance", "SELECT flow_id, CASE WHEN open_attempt IS NOT NULL THEN 'ambiguous' WHEN lifecycle = 'scheduled' THEN 'ready' ELSE lifecycle END AS lifecycle, CAST(NULL AS BIGINT) AS open_attempt, CAST(0 AS BIGINT) AS outstanding_reserved FROM flow_state")
def epoch_advance(t):
    return lifecycle.advance_epoch(t.flow_state)


# -- the books ---------------------------------------------------------------

GAUGES = ", ".join(f"count(*) FILTER (lifecycle = '{name}') AS {name.replace('-', '_')}" for name in accounting.LIFECYCLES)
GAUGES = f"SELECT count(*) AS total_flows, {GAUGES}, CAST(sum(served_work) AS BIGINT) AS service_credit_total, CAST(sum(estimated_work) AS BIGINT) AS estimated_work_total, CAST(sum(outstanding_reserved) AS BIGINT) AS outstanding_reserved_units FROM flows JOIN flow_state USING (flow_id)"
TRIES = ", ".join(f"count(*) FILTER (state = '{name}') AS attempts_{name}" for name in accounting.ATTEMPT_STATES)
TRIES = f"SELECT count(*) AS attempts_total, {TRIES}, CAST(coalesce(sum(CASE WHEN state IN ('open', 'started') THEN quantum END), 0) AS BIGINT) AS outstanding_units FROM attempts"
ISSUED = "SELECT count(DISTINCT schedule_id) AS schedules_issued, count(*) AS schedule_entries_issued, count(*) FILTER (kind = 'preempt') AS preemptions_issued FROM entries"
BOOKS = f"{ANSWERS}, books AS (SELECT g.*, a.*, d.*, i.*, (SELECT count(*) FILTER (deadline_missed_counted) FROM flow_state) AS deadline_misses, (SELECT CAST(sum(starvation_boosts) AS BIGINT) FROM flow_state) AS starvation_boosts, CAST({EPOCH} AS BIGINT) AS epoch, CAST(250 AS BIGINT) AS arbitration_rounds FROM ({GAUGES}) g, ({TRIES}) a, (SELECT {COUNTS} FROM answers) d, ({ISSUED}) i)"


def _report(t):
    return accounting.report(t.state, t.attempts, _answers(t), t.entries, EPOCH, 250)


@query("lifecycle_gauges", GAUGES)
def lifecycle_gauges(t):
    return accounting.lifecycle_gauges(t.state)


@query("attempt_gauges", TRIES)
def attempt_gauges(t):
    return accounting.attempt_gauges(t.attempts)


#: The identities, written out: sums by state, rest states, answers, holders, entries, misses, epoch.
VERDICT = """CASE WHEN waiting + ready + scheduled + dispatched + running + completion_reported + cancelling + preempting + completed + cancelled + failed + ambiguous <> total_flows THEN 'flows-by-state' WHEN cancelling <> 0 OR preempting <> 0 THEN 'transient-at-rest'
    WHEN attempts_open + attempts_started + attempts_committed + attempts_preempted + attempts_cancelled + attempts_abandoned + attempts_rejected <> attempts_total THEN 'attempts-by-state' WHEN completions_duplicate + completions_rejected > completion_reports_received THEN 'more-answers-than-reports'
    WHEN outstanding_reserved_units > 0 AND attempts_open + attempts_started + scheduled = 0 THEN 'reserved-by-nobody' WHEN schedules_issued > 0 AND schedule_entries_issued < schedules_issued THEN 'empty-schedule' WHEN deadline_misses > total_flows + cancelled + completed + failed THEN 'more-misses-than-flows' WHEN epoch = 0 THEN 'no-epoch' ELSE 'ok' END"""
#: Changes that break one identity each: what some columns become, in SQL that both engines read.
BREAKS = (
    {}, {"waiting": "waiting + 1"}, {"waiting": "waiting - 1", "preempting": "1"}, {"attempts_open": "attempts_open + 1"}, {"completions_rejected": "completion_reports_received + 1"},
    {"attempts_committed": "attempts_committed + attempts_open + attempts_started", "attempts_open": "0", "attempts_started": "0", "completed": "completed + scheduled", "scheduled": "0"}, {"schedule_entries_issued": "schedules_issued - 1"}, {"deadline_misses": "2 * total_flows + 1"}, {"epoch": "0"},
)


def broken_books(k: int) -> str:
    changes = ", ".join(f"{value} AS {name}" for name, value in BREAKS[k].items())
    return f"SELECT {k} AS k, {VERDICT} AS verdict FROM (SELECT * " + (f"REPLACE ({changes}) " if changes else "") + "FROM books)"


@query("books_close", f"{BOOKS} SELECT *, {VERDICT} AS verdict FROM books")
def books_close(t):
    return _report(t).withColumn("verdict", accounting.closure())


@query("books_broken", f"{BOOKS} " + " UNION ALL ".join(broken_books(k) for k in range(len(BREAKS))))
def books_broken(t):
    books = _report(t).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(len(BREAKS))])))
    names = sorted({name for change in BREAKS for name in change})
    arms = {name: " ".join(f"WHEN k = {k} THEN {change[name]}" for k, change in enumerate(BREAKS) if name in change) for name in names}
    return books.withColumns({name: F.expr(f"CAST(CASE {arm} ELSE {name} END AS BIGINT)") for name, arm in arms.items()}).select("k", accounting.closure().alias("verdict"))


@query("accounting_line", f"""{BOOKS} SELECT 'flows=' || total_flows || ' waiting=' || waiting || ' ready=' || ready || ' scheduled=' || scheduled || ' in-flight=' || (dispatched + running + completion_reported) || ' completed=' || completed || ' cancelled=' || cancelled || ' failed=' || failed || ' ambiguous=' || ambiguous
    || ' attempts=' || attempts_total || ' open=' || (attempts_open + attempts_started) || ' committed=' || attempts_committed || ' preempted=' || attempts_preempted || ' cancelled-attempts=' || attempts_cancelled || ' abandoned=' || attempts_abandoned || ' rejected-attempts=' || attempts_rejected
    || ' reports=' || completion_reports_received || ' applied=' || completions_applied || ' duplicates=' || completions_duplicate || ' rejected-completions=' || completions_rejected || ' schedules=' || schedules_issued || ' entries=' || schedule_entries_issued || ' rounds=' || arbitration_rounds
    || ' preemptions=' || preemptions_issued || ' boosts=' || starvation_boosts || ' deadline-misses=' || deadline_misses || ' reserved=' || outstanding_reserved_units || ' credit=' || service_credit_total || ' epoch=' || epoch AS line FROM books""")
def accounting_line(t):
    return _report(t).select(accounting.line().alias("line"))


# -- the log and explanations ------------------------------------------------


@query("journal_census", "SELECT type, count(*) AS records, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM journal GROUP BY type")
def journal_census(t):
    return eventlog.census(t.journal)


@query("journal_gap_scan", "SELECT DISTINCT sequence, before + 1 AS expected FROM (SELECT sequence, lag(sequence) OVER (ORDER BY sequence) AS before FROM (SELECT DISTINCT sequence FROM journal)) WHERE sequence <> before + 1")
def journal_gap_scan(t):
    return eventlog.gaps(t.journal)


@query("snapshot_fold", ", l AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY sequence DESC) AS i FROM journal) SELECT flow_id, type, tick, epoch, sequence FROM l WHERE i = 1")
def snapshot_fold(t):
    return eventlog.latest(t.journal)


@query("recovery_fold", """, l AS (SELECT flow_id, arg_max(type, sequence) AS last, CAST(coalesce(sum(amount) FILTER (type = 'completion-committed'), 0) AS BIGINT) AS served, count(*) FILTER (sequence > 400) AS replayed FROM journal GROUP BY flow_id)
    SELECT flow_id, CASE last WHEN 'attempt-opened' THEN 'ambiguous' WHEN 'completion-committed' THEN 'completed' WHEN 'attempt-closed' THEN 'ready' WHEN 'schedule-issued' THEN 'scheduled' ELSE 'waiting' END AS lifecycle, served, replayed FROM l""")
def recovery_fold(t):
    return eventlog.recover(t.journal, 400)


@query("history_tail", ", l AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY sequence DESC) AS i FROM journal) SELECT epoch, count(*) FILTER (i <= 32) AS steps, max(i) > 32 AS truncated, max(CASE WHEN i = 1 THEN type END) AS last_type FROM l GROUP BY epoch")
def history_tail(t):
    return explain.history_tail(t.journal, key="epoch")


TIER = f"CAST(CASE WHEN deadline_tick IS NOT NULL AND greatest(deadline_tick - {NOW}, 0) <= 20 THEN 0 WHEN ever_ready AND {NOW} - eligible_since_tick >= 1000 THEN 1 WHEN min_service > 0 AND min_service_delivered < min_service THEN 2 ELSE 3 END AS INT)"
KEY_FNV = fnv_sql("tier", "rank", "coalesce(CAST(deadline_tick AS UBIGINT), 18446744073709551615)", "virtual_finish", "18446744073709551615 - CAST(weight AS UBIGINT)", "flow_id", "generation", widths=(4, 4, 8, 8, 8, 8, 8))
KEYS = f"SELECT f.*, s.* EXCLUDE (flow_id), {TIER} AS tier, p.rank FROM flows f JOIN flow_state s USING (flow_id) JOIN priority_classes p USING (priority_id)"
REASON = "CASE type WHEN 'schedule-issued' THEN 'selected' WHEN 'attempt-closed' THEN 'displaced-by-higher-authority' ELSE type END"


@query("explain_flow", f""", l AS (SELECT flow_id, sequence, {REASON} AS reason, row_number() OVER (PARTITION BY flow_id ORDER BY sequence DESC) AS i FROM journal), h AS (SELECT flow_id, count(*) FILTER (i <= 32) AS steps, max(i) > 32 AS truncated, max(CASE WHEN i = 1 THEN reason END) AS last_reason, string_agg(reason, ',' ORDER BY sequence) FILTER (i <= 32) AS trail FROM l GROUP BY flow_id)
    SELECT flow_id, generation, lifecycle, tier, {KEY_FNV} AS ordering_digest, coalesce(last_reason, 'selected') AS last_reason, coalesce(steps, 0) AS steps, coalesce(truncated, false) AS truncated, coalesce(trail, '') AS trail FROM ({KEYS}) k LEFT JOIN h USING (flow_id)""")
def explain_flow(t):
    reason = F.when(c("type") == "schedule-issued", "selected").when(c("type") == "attempt-closed", "displaced-by-higher-authority").otherwise(c("type"))
    told = explain.explain_flow(ranking.with_key(t.state, t.priority_classes, POLICY, NOW), t.journal.withColumn("reason", reason))
    return told.withColumn("trail", F.coalesce(F.array_join(F.transform("history", lambda x: x["reason"]), ","), F.lit(""))).drop("history")


@query("explain_schedule", "SELECT schedule_id, ordinal, kind || ' flow#' || flow_id || ' quantum=' || quantum || ' tier=' || tier || ' consumed=' || consumed || ' (' || reason || ')' AS line FROM entries")
def explain_schedule(t):
    return t.entries.select("schedule_id", "ordinal", explain.entry_line().alias("line"))


@query("schedule_canonical", "SELECT schedule_id, count(*) FILTER (kind = 'run') AS runs, count(*) FILTER (kind = 'preempt') AS preempts, coalesce(string_agg(concat_ws(':', ordinal, kind, flow_id, flow_generation, resource_id, quantum), '|' ORDER BY ordinal) FILTER (ordinal < 256), '') AS canonical FROM entries GROUP BY schedule_id")
def schedule_canonical(t):
    return explain.canonical(t.entries)


@query("order_digest", f"SELECT flow_id, {KEY_FNV} AS digest FROM ({KEYS}) k")
def order_digest(t):
    return ranking.with_key(t.state, t.priority_classes, POLICY, NOW).select("flow_id", ranking.key_digest().alias("digest"))
