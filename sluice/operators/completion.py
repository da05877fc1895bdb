"""Completion evidence: every report is answered once, committed at most once, and refused with a typed code otherwise.

Late, stale and contradictory reports are rows of the result, not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.names import is_attempt_terminal
from sluice.functions.scalars import first_match
from sluice.policy import MAX_SERVICE

c = F.col
#: Fields that make two reports the same.
EVIDENCE_FIELDS = ("attempt_id", "epoch", "schedule_id", "schedule_generation", "flow_id", "flow_generation", "worker", "boot", "outcome", "served", "tick", "origin")


def evidence_digest() -> Column:
    """A digest of all fields of a report; two reports are the same if theirs are equal."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c(f).cast("string"), F.lit("")) for f in EVIDENCE_FIELDS]), 256)


def dedupe(evidence: DataFrame, order: str = "sequence") -> DataFrame:
    """evidence with kind: first of its attempt, exact repeat of it, or contradictory to it."""
    first = Window.partitionBy("attempt_id").orderBy(order)
    own = evidence_digest()
    head = F.first(own).over(first)
    kind = first_match([(F.row_number().over(first) == 1, "first"), (own == head, "exact")], "contradictory")
    return evidence.withColumn("kind", kind)


def reject_code(epoch: int) -> Column:
    """The code by which a report is refused before its attempt's history counts, or null; over evidence joined with _flow_* and _att_* columns."""
    missing = [F.coalesce(c(k), F.lit(0)) == 0 for k in ("schedule_id", "schedule_generation", "flow_id", "flow_generation", "worker", "boot", "epoch", "attempt_id")]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    return first_match(
        [
            (c("origin") == "unknown", "invalid-argument"),
            (any_missing, "invalid-argument"),
            (c("served") > MAX_SERVICE, "out-of-range"),
            (c("epoch") != epoch, "stale-epoch"),
            (c("_flow_generation").isNull(), "unknown-flow"),
            (c("_flow_generation") != c("flow_generation"), "stale-flow-generation"),
            (c("_att_state").isNull(), "unknown-attempt"),
            ((c("_att_flow") != c("flow_id")) | (c("_att_schedule") != c("schedule_id")), "contradictory-completion"),
            (c("_att_generation") != c("schedule_generation"), "stale-schedule-generation"),
            ((c("_att_worker") != c("worker")) | (c("_att_boot") != c("boot")), "fenced"),
        ],
        None,
    )


def joined(evidence: DataFrame, attempts: DataFrame, state: DataFrame) -> DataFrame:
    held = attempts.select("attempt_id", c("flow_id").alias("_att_flow"), c("schedule_id").alias("_att_schedule"), c("schedule_generation").alias("_att_generation"), c("worker").alias("_att_worker"), c("boot").alias("_att_boot"), c("state").alias("_att_state"), c("quantum").alias("_att_quantum"), c("deadline_tick").alias("_att_deadline"), c("evidence_digest").alias("_att_evidence"), c("credited").alias("_att_credited"))
    flows = state.select("flow_id", c("generation").alias("_flow_generation"), c("open_attempt").alias("_flow_attempt"), c("served_work").alias("_flow_served"), c("estimated_work").alias("_flow_work"))
    return evidence.join(flows, "flow_id", "left").join(held, "attempt_id", "left")


def dispositions(evidence: DataFrame, attempts: DataFrame, state: DataFrame, epoch: int, now: int) -> DataFrame:
    """A row per report: sequence, attempt_id, flow_id, disposition, code, credited, lifecycle_after.

    The first report that passes closes its attempt; later ones of the attempt are exact repeats of it or contradict it.
    A closed attempt keeps the digest of all fields of the report that closed it, so the answers are the same however the
    reports are split into batches.
    """
    rows = joined(evidence, attempts, state).withColumns({"_code": reject_code(epoch), "_own": evidence_digest()})
    served = c("outcome") == "served"
    late = served & F.coalesce(c("_att_deadline") <= now, F.lit(False))
    fails = first_match(
        [
            (c("_code").isNotNull(), c("_code")),
            (is_attempt_terminal(c("_att_state")) & (c("_att_evidence") == c("_own")) & (c("_att_state") == "committed"), "duplicate-completion"),
            (is_attempt_terminal(c("_att_state")) & (c("_att_evidence") == c("_own")), "completion-for-closed-attempt"),
            (is_attempt_terminal(c("_att_state")) & c("_att_evidence").isNotNull(), "contradictory-completion"),
            (is_attempt_terminal(c("_att_state")), "completion-for-closed-attempt"),
            (F.coalesce(c("_flow_attempt") != c("attempt_id"), F.lit(True)), "stale-attempt"),
        ],
        None,
    )
    rows = rows.withColumn("_fails", fails)
    unfit = F.when(c("served") > c("_att_quantum"), "contradictory-completion").when(late, "deadline-passed")
    rows = rows.withColumn("_unfit", unfit)
    # of the reports that reach the open attempt, the first that fits is applied and closes it
    line = Window.partitionBy("attempt_id", c("_fails").isNull())
    applied = F.min(F.when(c("_fails").isNull() & c("_unfit").isNull(), c("sequence"))).over(line)
    rows = rows.withColumn("_applied", applied)
    rows = rows.withColumn("_content", F.max(F.when(c("sequence") == c("_applied"), c("_own"))).over(line))
    code = first_match(
        [
            (c("_fails").isNotNull(), c("_fails")),
            (c("sequence") == c("_applied"), "ok"),
            (c("sequence") < c("_applied"), c("_unfit")),
            (c("_applied").isNull(), c("_unfit")),
            (c("_own") == c("_content"), "duplicate-completion"),
        ],
        "contradictory-completion",
    )
    rows = rows.withColumn("code", code)
    credited = F.when(c("code") == "ok", F.when(served, c("served")).otherwise(F.lit(0))).when(c("code") == "duplicate-completion", F.when(c("_fails").isNotNull(), c("_att_credited")).when(served, c("served")).otherwise(F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("credited", credited.cast("long"))
    after = first_match([(c("code") != "ok", None), (c("outcome") == "failed", "failed"), (c("_flow_served") + c("credited") >= c("_flow_work"), "completed")], "waiting")
    disposition = first_match([(c("code") == "ok", "applied"), (c("code") == "duplicate-completion", "idempotent-duplicate")], "rejected")
    return rows.select("sequence", "attempt_id", "flow_id", disposition.alias("disposition"), "code", "credited", after.alias("lifecycle_after"))


def commit(answers: DataFrame, state: DataFrame) -> DataFrame:
    """(flow_id, served_work, lifecycle, closed_attempt) of flows for which a report was applied."""
    applied = answers.filter(c("disposition") == "applied").groupBy("flow_id").agg(F.sum("credited").alias("_credit"), F.max("lifecycle_after").alias("lifecycle"), F.max("attempt_id").alias("closed_attempt"))
    return applied.join(state.select("flow_id", "served_work"), "flow_id").select("flow_id", (c("served_work") + c("_credit")).alias("served_work"), "lifecycle", "closed_attempt")
