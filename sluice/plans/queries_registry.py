"""Registered queries over descriptors, predicates and scalar functions, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import names, scalars
from sluice.functions.digests import fnv
from sluice.operators import accounting, registry
from sluice.sources.derived import DUCK, NOW, fnv_sql, tables

c = F.col
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query over the derived tables, and the SELECT that DuckDB answers it with."""

    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: make(tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = f"{DUCK} {oracle}"
        return make

    return keep


BAD, FAR = "'invalid-argument'", "'out-of-range'"
VALID = f"""CASE WHEN coalesce(flow_id, 0) = 0 OR coalesce(generation, 0) = 0 OR coalesce(path_id, 0) = 0 OR coalesce(path_generation, 0) = 0 OR coalesce(resource_id, 0) = 0 OR coalesce(priority_id, 0) = 0 OR coalesce(qos_id, 0) = 0 OR coalesce(fairness_group, 0) = 0 THEN {BAD}
    WHEN (reservation_id IS NULL) <> (reservation_generation IS NULL) THEN {BAD} WHEN estimated_work < 1 OR estimated_work > {1 << 48} THEN {FAR} WHEN service_quantum < 1 OR service_quantum > {1 << 40} THEN {FAR} WHEN min_service > estimated_work THEN {BAD}
    WHEN min_service > 0 AND min_service_window = 0 THEN {BAD} WHEN min_service_window > {1 << 60} OR release_tick > {1 << 60} OR deadline_tick > {1 << 60} THEN {FAR} WHEN deadline_tick <= release_tick THEN {BAD} WHEN weight < 1 THEN {FAR} WHEN len(dependencies) > 4096 THEN 'bound-exceeded' WHEN readiness_signal NOT BETWEEN 0 AND 2 THEN {BAD}
    WHEN len(list_distinct(dependencies)) < len(dependencies) OR list_contains(dependencies, flow_id) OR list_contains(dependencies, 0) THEN {BAD} ELSE 'ok' END"""
#: Flows whose descriptor breaks a rule, by the remainder of the id: column, and the value that it gets (in SQL that both engines read).
BROKEN = (
    (1, "path_id", "0"), (2, "resource_id", "NULL"), (3, "priority_id", "0"), (4, "qos_id", "NULL"), (5, "fairness_group", "0"), (6, "reservation_generation", "CASE WHEN reservation_id IS NULL THEN 1 END"), (7, "estimated_work", "0"), (8, "service_quantum", str((1 << 40) + 1)),
    (9, "min_service", "estimated_work + 1"), (10, "min_service_window", str((1 << 60) + 1)), (11, "release_tick", str((1 << 60) + 1)), (12, "deadline_tick", "release_tick"), (13, "weight", "0"), (14, "readiness_signal", "3"), (15, "generation", "0"),
)


def _broken(t):
    flows = t.flows
    for k, name, value in BROKEN:
        flows = flows.withColumn(name, F.expr(f"CASE WHEN flow_id % 61 = {k} THEN CAST({value} AS {'INT' if name == 'readiness_signal' else 'BIGINT'}) ELSE {name} END"))
    own, twice, many = F.array("flow_id"), F.array(c("flow_id") + 1, c("flow_id") + 1), F.sequence(c("flow_id") + 1, c("flow_id") + 4097)
    return flows.withColumn("dependencies", F.when(c("flow_id") % 61 == 16, own).when(c("flow_id") % 61 == 17, twice).when(c("flow_id") % 61 == 18, F.array(F.lit(0).cast("long"))).when(c("flow_id") % 2440 == 2380, many).otherwise(c("dependencies")))


def broken_sql() -> str:
    text = "flows"
    for k, name, value in BROKEN:
        text = f"(SELECT * REPLACE (CASE WHEN flow_id % 61 = {k} THEN {value} ELSE {name} END AS {name}) FROM {text})"
    return f"(SELECT * REPLACE (CASE WHEN flow_id % 61 = 16 THEN [flow_id] WHEN flow_id % 61 = 17 THEN [flow_id + 1, flow_id + 1] WHEN flow_id % 61 = 18 THEN [0] WHEN flow_id % 2440 = 2380 THEN range(flow_id + 1, flow_id + 4098) ELSE dependencies END AS dependencies) FROM {text})"


@query("validate_flow", f"SELECT flow_id, {VALID} AS status FROM {broken_sql()}")
def validate_flow(t):
    return _broken(t).select("flow_id", registry.validate_flow().alias("status"))


#: Descriptors that break a rule each: a variant of every row for each k.
VARIANTS = "(VALUES (0), (1), (2), (3), (4), (5)) v(k)"


@query("validate_descriptors", f"""SELECT 'resource' AS kind, resource_id AS id, k, CASE WHEN k IN (1, 2) THEN {BAD} WHEN k IN (3, 4, 5) THEN {FAR} ELSE 'ok' END AS status FROM resources, {VARIANTS}
    UNION ALL SELECT 'reservation', reservation_id, k, CASE WHEN k IN (1, 2, 3) THEN {BAD} WHEN k IN (4, 5) THEN {FAR} ELSE 'ok' END FROM reservations, {VARIANTS}
    UNION ALL SELECT 'priority', priority_id, k, CASE WHEN k IN (1, 2) THEN {BAD} WHEN k = 3 THEN {FAR} ELSE 'ok' END FROM priority_classes, {VARIANTS} UNION ALL SELECT 'qos', qos_id, k, CASE WHEN k IN (1, 2) THEN {BAD} WHEN k = 3 THEN {FAR} ELSE 'ok' END FROM qos_classes, {VARIANTS}""")
def validate_descriptors(t):
    def one(frame, kind, key, status, **changes):
        rows = frame.withColumns({"_id": c(key), "k": F.explode(F.array(*[F.lit(k) for k in range(6)]))})
        for name, (k, value) in changes.items():
            rows = rows.withColumn(name, F.when(c("k") == k, value).otherwise(c(name)))
        return rows.select(F.lit(kind).alias("kind"), c("_id").alias("id"), "k", status.alias("status"))

    nothing, far = F.lit(None).cast("long"), F.lit((1 << 60) + 1)
    out = one(t.resources, "resource", "resource_id", registry.validate_resource(), resource_id=(1, nothing), generation=(2, nothing), capacity=(3, F.lit(0)), interval_ticks=(4, far), max_overlap=(5, nothing))
    out = out.unionByName(one(t.reservations, "reservation", "reservation_id", registry.validate_reservation(), reservation_id=(1, F.lit(0)), resource_generation=(2, nothing), window_begin=(3, c("window_end")), window_end=(4, far), capacity=(5, F.lit(0))))
    out = out.unionByName(one(t.priority_classes, "priority", "priority_id", registry.validate_priority_class(), priority_id=(1, nothing), generation=(2, F.lit(0)), weight=(3, F.lit(0))))
    return out.unionByName(one(t.qos_classes, "qos", "qos_id", registry.validate_qos_class(), qos_id=(1, nothing), generation=(2, F.lit(0)), max_service_per_dispatch=(3, far)))


@query("upsert_generation", """, offers AS (SELECT resource_id, CASE WHEN k = 3 AND resource_id % 3 = 0 THEN 5 ELSE k END + generation AS generation, resource_id * 10 + CASE WHEN resource_id % 5 = 0 THEN 10 - k ELSE k END AS sequence FROM resources, (VALUES (1), (2), (3)) v(k)),
    m AS (SELECT *, dense_rank() OVER (PARTITION BY resource_id ORDER BY generation) AS d, max(sequence) OVER (PARTITION BY resource_id ORDER BY generation) AS top FROM offers)
    SELECT resource_id, CAST(m.generation AS BIGINT) AS generation, CAST(sequence AS BIGINT) AS sequence, CASE WHEN m.generation = 1 + d AND top = sequence THEN 'ok' ELSE 'invalid-argument' END AS status FROM m""")
def upsert_generation(t):
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    offers = t.resources.select("resource_id", c("generation").alias("_g"), k.alias("_k"))
    skipped = F.when((c("_k") == 3) & (c("resource_id") % 3 == 0), 5).otherwise(c("_k"))
    turned = F.when(c("resource_id") % 5 == 0, 10 - c("_k")).otherwise(c("_k"))
    offers = offers.select("resource_id", (skipped + c("_g")).cast("long").alias("generation"), (c("resource_id") * 10 + turned).cast("long").alias("sequence"))
    return registry.upsert_generations(t.resources, offers, "resource_id")


@query("register_reservation", "SELECT reservation_id, CASE WHEN reservation_id % 7 = 0 THEN 'unknown-resource' WHEN reservation_id % 5 = 0 THEN 'stale-resource-generation' ELSE 'ok' END AS status FROM reservations")
def register_reservation(t):
    offered = t.reservations.withColumn("resource_id", F.when(c("reservation_id") % 7 == 0, F.lit(99).cast("long")).otherwise(c("resource_id"))).withColumn("resource_generation", F.when(c("reservation_id") % 5 == 0, F.lit(2).cast("long")).otherwise(c("resource_generation")))
    return registry.register_reservations(offered, t.resources).select("reservation_id", "status")


@query("retire_reservation", """SELECT r.id AS reservation_id, r.g AS request_generation, CASE WHEN v.generation IS NULL THEN 'unknown-reservation' WHEN v.generation <> r.g THEN 'stale-reservation-generation' ELSE 'ok' END AS status,
    coalesce(v.retired OR v.generation = r.g, false) AS retired FROM (SELECT resource_id AS id, CAST(1 AS BIGINT) AS g FROM resources) r LEFT JOIN reservations v ON v.reservation_id = r.id""")
def retire_reservation(t):
    return registry.retire_reservations(t.reservations, t.resources.select(c("resource_id").alias("reservation_id"), F.lit(1).cast("long").alias("request_generation")))


OFFERED = "SELECT * REPLACE (CASE WHEN flow_id % 101 = 0 THEN 2 ELSE resource_generation END AS resource_generation, CASE WHEN flow_id % 103 = 0 THEN 9 ELSE priority_id END AS priority_id), flow_id * 2 AS sequence FROM flows"


def _offered(t):
    stale = F.when(c("flow_id") % 101 == 0, F.lit(2).cast("long")).otherwise(c("resource_generation"))
    once = t.flows.withColumns({"resource_generation": stale, "priority_id": F.when(c("flow_id") % 103 == 0, F.lit(9).cast("long")).otherwise(c("priority_id")), "sequence": c("flow_id") * 2})
    return once.unionByName(once.filter(c("flow_id") % 9 == 0).withColumn("sequence", c("sequence") + 1))


@query("admit_flow", f""", o AS (SELECT *, {VALID} AS v FROM (SELECT * FROM ({OFFERED}) UNION ALL SELECT * REPLACE (sequence + 1 AS sequence) FROM ({OFFERED}) WHERE flow_id % 9 = 0))
    SELECT flow_id, sequence, CASE WHEN v <> 'ok' THEN v WHEN sequence % 2 = 1 THEN 'already-exists' WHEN resource_generation <> 1 THEN 'stale-resource-generation' WHEN priority_id = 9 THEN 'unknown-policy' WHEN o.reservation_id IS NOT NULL AND r.reservation_id IS NULL THEN 'unknown-reservation'
    WHEN r.generation <> o.reservation_generation THEN 'stale-reservation-generation' ELSE 'ok' END AS status FROM o LEFT JOIN (SELECT reservation_id, generation FROM reservations WHERE NOT retired) r USING (reservation_id)""")
def admit_flow(t):
    return registry.admit_flows(_offered(t), t.resources, t.priority_classes, t.qos_classes, t.reservations, "sequence").select("flow_id", "sequence", "status")


@query("update_flow", f""", o AS (SELECT f.*, s.lifecycle, s.served_work, CASE WHEN flow_id % 6 = 0 THEN 3 ELSE 2 END AS offered, {VALID} AS v FROM flows f LEFT JOIN flow_state s USING (flow_id))
    SELECT flow_id, CAST(offered AS BIGINT) AS generation, status, coalesce(status = 'ok' AND lifecycle = 'scheduled', false) AS releases_window FROM (SELECT o.*, CASE WHEN v <> 'ok' THEN v WHEN offered <> 2 THEN 'invalid-argument'
    WHEN (len(dependencies) > 0 OR flow_id % 4 = 0) AND lifecycle <> 'waiting' AND served_work > 0 THEN 'invalid-state' WHEN o.reservation_id IS NOT NULL AND r.reservation_id IS NULL THEN 'unknown-reservation'
    WHEN r.generation <> o.reservation_generation THEN 'stale-reservation-generation' ELSE 'ok' END AS status FROM o LEFT JOIN (SELECT reservation_id, generation FROM reservations WHERE NOT retired) r USING (reservation_id)) WHERE lifecycle IS NOT NULL""")
def update_flow(t):
    known = t.flow_state.select("flow_id")
    offered = t.flows.join(known, "flow_id", "left_semi").withColumn("generation", F.when(c("flow_id") % 6 == 0, F.lit(3)).otherwise(F.lit(2)).cast("long")).withColumn("estimated_work", F.when(c("flow_id") % 4 == 0, c("estimated_work") + 1).otherwise(c("estimated_work")))
    offered = offered.withColumn("min_service", F.when((c("flow_id") % 4 == 0) & (c("min_service") == c("estimated_work")), c("min_service") + 1).otherwise(c("min_service")))
    return registry.update_flows(t.state, offered, t.resources, t.priority_classes, t.qos_classes, t.reservations)


RES_DIGEST, BOOK_DIGEST = ("resource_id", "generation", "capacity", "interval_ticks", "max_overlap"), ("reservation_id", "generation", "resource_id", "resource_generation", "window_begin", "window_end", "capacity", "exclusive")
CLASS_DIGEST, QOS_DIGEST = ("priority_id", "generation", "rank", "weight"), ("qos_id", "generation", "preemption_protected", "max_service_per_dispatch")
FLOW_DIGEST = (
    "flow_id", "generation", "path_id", "path_generation", "resource_id", "resource_generation", "reservation_id", "reservation_generation", "priority_id", "priority_generation", "qos_id", "qos_generation", "fairness_group", "estimated_work", "service_quantum", "min_service", "min_service_window",
    "release_tick + 10000", "coalesce(deadline_tick, 0) + 10000", "weight", "preemptible", "auto_ready", "readiness_signal",
)


@query("descriptor_digest", f"""SELECT 'resource' AS kind, resource_id AS id, {fnv_sql(*RES_DIGEST)} AS digest FROM resources UNION ALL SELECT 'reservation', reservation_id, {fnv_sql(*BOOK_DIGEST, widths=(8,) * 7 + (1,))} FROM reservations
    UNION ALL SELECT 'priority', priority_id, {fnv_sql(*CLASS_DIGEST, widths=(8, 8, 4, 8))} FROM priority_classes UNION ALL SELECT 'qos', qos_id, {fnv_sql(*QOS_DIGEST, widths=(8, 8, 1, 8))} FROM qos_classes
    UNION ALL SELECT 'flow', flow_id, {fnv_sql(*FLOW_DIGEST, widths=(8,) * 20 + (1,) * 3, listed='dependencies')} FROM flows""")
def descriptor_digest(t):
    one = lambda frame, kind, key, value: frame.select(F.lit(kind).alias("kind"), c(key).alias("id"), value.alias("digest"))
    fields = lambda names: [F.expr(n) for n in names]
    out = one(t.resources, "resource", "resource_id", fnv(*fields(RES_DIGEST))).unionByName(one(t.reservations, "reservation", "reservation_id", fnv(*fields(BOOK_DIGEST), widths=(8,) * 7 + (1,))))
    out = out.unionByName(one(t.priority_classes, "priority", "priority_id", fnv(*fields(CLASS_DIGEST), widths=(8, 8, 4, 8)))).unionByName(one(t.qos_classes, "qos", "qos_id", fnv(*fields(QOS_DIGEST), widths=(8, 8, 1, 8))))
    own = fnv(*fields(FLOW_DIGEST), c("dependencies"), widths=(8,) * 20 + (1,) * 3 + (8,), listed=len(FLOW_DIGEST))
    return out.unionByName(one(t.flows, "flow", "flow_id", own))


@query("flow_snapshot", "SELECT flow_id, generation, lifecycle, served_work, CAST(greatest(estimated_work - served_work, 0) AS BIGINT) AS remaining FROM flows JOIN flow_state USING (flow_id)")
def flow_snapshot(t):
    return t.state.select("flow_id", "generation", "lifecycle", "served_work", scalars.nominal_work(c("estimated_work"), c("served_work")).alias("remaining"))


@query("attempt_lookup", "SELECT attempt_id, a.flow_id, state, quantum, lifecycle FROM attempts a LEFT JOIN flow_state s ON s.open_attempt = a.attempt_id WHERE a.epoch = 3")
def attempt_lookup(t):
    live = t.flow_state.filter(c("open_attempt").isNotNull()).select(c("open_attempt").alias("attempt_id"), "lifecycle")
    return t.attempts.filter(c("epoch") == 3).join(live, "attempt_id", "left").select("attempt_id", "flow_id", "state", "quantum", "lifecycle")


@query("lifecycle_bucket", """SELECT lifecycle, CASE WHEN lifecycle IN ('dispatched', 'running', 'completion-reported', 'cancelling', 'preempting') THEN 'in-flight' ELSE lifecycle END AS bucket,
    lifecycle IN ('completed', 'cancelled', 'failed') AS terminal, count(*) AS flows FROM flow_state GROUP BY lifecycle""")
def lifecycle_bucket(t):
    return t.flow_state.groupBy("lifecycle").agg(F.count("flow_id").alias("flows")).select("lifecycle", names.bucket_of(c("lifecycle")).alias("bucket"), names.is_terminal(c("lifecycle")).alias("terminal"), "flows")


@query("reservation_window", f"SELECT reservation_id, {NOW} >= window_begin AND {NOW} < window_end AS open, CASE WHEN {NOW} >= window_begin AND {NOW} < window_end THEN capacity ELSE 0 END AS granted FROM reservations")
def reservation_window(t):
    open_ = scalars.window_contains(c("window_begin"), c("window_end"), NOW)
    return t.reservations.select("reservation_id", open_.alias("open"), F.when(open_, c("capacity")).otherwise(F.lit(0).cast("long")).alias("granted"))


@query("ticks_between", f"SELECT flow_id, deadline_tick IS NOT NULL AS has_deadline, CASE WHEN deadline_tick IS NOT NULL THEN CAST(greatest(deadline_tick - {NOW}, 0) AS BIGINT) END AS slack FROM flows")
def ticks_between(t):
    return t.flows.select("flow_id", c("deadline_tick").isNotNull().alias("has_deadline"), scalars.ticks_between(F.lit(NOW).cast("long"), c("deadline_tick")).cast("long").alias("slack"))


@query("error_class", """, q AS (SELECT flow_id, CASE WHEN flow_id % 4 = 0 THEN 'not-ready' WHEN flow_id % 4 = 1 THEN 'stale-epoch' WHEN flow_id % 4 = 2 THEN 'fenced' ELSE 'unknown-flow' END AS code FROM flows)
    SELECT code, CASE code WHEN 'not-ready' THEN 'transient' WHEN 'unknown-flow' THEN 'final' ELSE 'stale' END AS class, count(*) AS n FROM q GROUP BY code""")
def error_class(t):
    code = scalars.first_match([(c("flow_id") % 4 == 0, "not-ready"), (c("flow_id") % 4 == 1, "stale-epoch"), (c("flow_id") % 4 == 2, "fenced")], "unknown-flow")
    return t.flows.groupBy(code.alias("code")).agg(F.count("flow_id").alias("n")).select("code", names.error_class(c("code")).alias("class"), "n")


@query("counts", "SELECT (SELECT count(*) FROM flows) AS flows, (SELECT count(*) FROM attempts) AS attempts, (SELECT max(sequence) FROM journal) AS journal_position, (SELECT max(epoch) FROM attempts) AS epoch")
def counts(t):
    one = lambda frame, value, name: frame.agg(value.alias(name)).withColumn("_k", F.lit(0))
    out = one(t.flows, F.count("flow_id"), "flows").join(one(t.attempts, F.count("attempt_id"), "attempts"), "_k")
    return out.join(one(t.journal, F.max("sequence"), "journal_position"), "_k").join(one(t.attempts, F.max("epoch"), "epoch"), "_k").drop("_k")


@query("id_text", "SELECT flow_id, 'flow#' || flow_id AS flow, 'reservation#' || coalesce(reservation_id, 0) AS reservation, 'external/seq=' || flow_id || '/digest=' || path_id AS provenance FROM flows")
def id_text(t):
    return t.flows.select("flow_id", scalars.id_text("flow", c("flow_id")).alias("flow"), scalars.id_text("reservation", c("reservation_id")).alias("reservation"), scalars.provenance_text(F.lit("external"), c("flow_id"), c("path_id")).alias("provenance"))


@query("bounded_detail", """, q AS (SELECT flow_id, regexp_replace(repeat('step' || chr(9) || flow_id || chr(10), CAST(flow_id % 400 AS INT)), '[\\x00-\\x1F\\x7F]', ' ', 'g') AS s FROM flows)
    SELECT flow_id, CASE WHEN length(s) > 2048 THEN left(s, 2045) || '...' ELSE s END AS detail, left(s, 512) AS message FROM q""")
def bounded_detail(t):
    raw = F.expr("repeat(concat('step', chr(9), cast(flow_id as string), chr(10)), cast(flow_id % 400 as int))")
    return t.flows.select("flow_id", scalars.bounded_detail(raw).alias("detail"), scalars.error_message(scalars.bounded_detail(raw, 1 << 20)).alias("message"))


@query("wait_max", "SELECT max(wait_ticks) AS max_wait, CAST(count(*) AS DOUBLE) / (max(last_change_tick) - min(last_change_tick)) AS flows_per_tick FROM flow_state")
def wait_max(t):
    return t.flow_state.agg(F.max("wait_ticks").alias("max_wait"), (F.count("flow_id").cast("double") / (F.max("last_change_tick") - F.min("last_change_tick"))).alias("flows_per_tick"))


@query("wait_percentiles", """, w AS (SELECT wait_ticks + flow_id % 7 AS v FROM flow_state), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM w)
    SELECT s AS share, v AS value FROM r, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) x(s) WHERE i = CAST(floor(s * (n - 1) + 0.5) AS BIGINT)""")
def wait_percentiles(t):
    return accounting.wait_percentiles(t.flow_state.select((c("wait_ticks") + c("flow_id") % 7).alias("wait_ticks")))
