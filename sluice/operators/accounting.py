"""The books: gauges by state, counters by disposition, and the identities that must hold between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.names import ATTEMPT_STATES, LIFECYCLES, LIVE_ATTEMPTS
from sluice.functions.scalars import first_match

c = F.col


def lifecycle_gauges(state: DataFrame) -> DataFrame:
    """One row: flows in all and in each state, service credited, work estimated, units reserved."""
    gauges = [F.count_if(c("lifecycle") == name).alias(name.replace("-", "_")) for name in LIFECYCLES]
    sums = [F.coalesce(F.sum(col), F.lit(0)).cast("long").alias(name) for col, name in (("served_work", "service_credit_total"), ("estimated_work", "estimated_work_total"), ("outstanding_reserved", "outstanding_reserved_units"))]
    return state.agg(F.count("flow_id").alias("total_flows"), *gauges, *sums)


def attempt_gauges(attempts: DataFrame) -> DataFrame:
    """One row: attempts in all and in each state, units that live ones hold."""
    gauges = [F.count_if(c("state") == name).alias(f"attempts_{name}") for name in ATTEMPT_STATES]
    live = F.coalesce(F.sum(F.when(c("state").isin(*LIVE_ATTEMPTS), c("quantum"))), F.lit(0)).cast("long")
    return attempts.agg(F.count("attempt_id").alias("attempts_total"), *gauges, live.alias("outstanding_units"))


def disposition_counts(answers: DataFrame) -> DataFrame:
    """One row: reports received, applied, repeated and rejected."""
    count = lambda name: F.count_if(c("disposition") == name)
    return answers.agg(F.count("disposition").alias("completion_reports_received"), count("applied").alias("completions_applied"), count("idempotent-duplicate").alias("completions_duplicate"), count("rejected").alias("completions_rejected"))


def report(state: DataFrame, attempts: DataFrame, answers: DataFrame, entries: DataFrame, epoch: int, rounds: int) -> DataFrame:
    """One row with all counters that the identities need; rounds: how many have been run."""
    issued = entries.agg(F.count_distinct("schedule_id").alias("schedules_issued"), F.count("flow_id").alias("schedule_entries_issued"), F.count_if(c("kind") == "preempt").alias("preemptions_issued"))
    misses = state.agg(F.count_if(c("deadline_missed_counted")).alias("deadline_misses"), F.coalesce(F.sum("starvation_boosts"), F.lit(0)).cast("long").alias("starvation_boosts"))
    parts = [frame.withColumn("_k", F.lit(0)) for frame in (lifecycle_gauges(state), attempt_gauges(attempts), disposition_counts(answers), issued, misses)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "_k")
    return out.drop("_k").withColumns({"epoch": F.lit(epoch).cast("long"), "arbitration_rounds": F.lit(rounds).cast("long")})


def closure() -> Column:
    """A code for the first identity that a report breaks, or 'ok'."""
    total = sum((c(name.replace("-", "_")) for name in LIFECYCLES[1:]), c(LIFECYCLES[0]))
    tries = sum((c(f"attempts_{name}") for name in ATTEMPT_STATES[1:]), c(f"attempts_{ATTEMPT_STATES[0]}"))
    return first_match(
        [
            (total != c("total_flows"), "flows-by-state"),
            ((c("cancelling") != 0) | (c("preempting") != 0), "transient-at-rest"),
            (tries != c("attempts_total"), "attempts-by-state"),
            (c("completions_duplicate") + c("completions_rejected") > c("completion_reports_received"), "more-answers-than-reports"),
            ((c("outstanding_reserved_units") > 0) & (c("attempts_open") + c("attempts_started") + c("scheduled") == 0), "reserved-by-nobody"),
            ((c("schedules_issued") > 0) & (c("schedule_entries_issued") < c("schedules_issued")), "empty-schedule"),
            (c("deadline_misses") > c("total_flows") + c("cancelled") + c("completed") + c("failed"), "more-misses-than-flows"),
            (c("epoch") == 0, "no-epoch"),
        ],
        "ok",
    )


# What the one-line report shows, as label and column expression, in its order.
LINE = (
    ("flows", "total_flows"), ("waiting", "waiting"), ("ready", "ready"), ("scheduled", "scheduled"), ("in-flight", "dispatched + running + completion_reported"), ("completed", "completed"), ("cancelled", "cancelled"), ("failed", "failed"),
    ("ambiguous", "ambiguous"), ("attempts", "attempts_total"), ("open", "attempts_open + attempts_started"), ("committed", "attempts_committed"), ("preempted", "attempts_preempted"), ("cancelled-attempts", "attempts_cancelled"),
    ("abandoned", "attempts_abandoned"), ("rejected-attempts", "attempts_rejected"), ("reports", "completion_reports_received"), ("applied", "completions_applied"), ("duplicates", "completions_duplicate"), ("rejected-completions", "completions_rejected"),
    ("schedules", "schedules_issued"), ("entries", "schedule_entries_issued"), ("rounds", "arbitration_rounds"), ("preemptions", "preemptions_issued"), ("boosts", "starvation_boosts"), ("deadline-misses", "deadline_misses"), ("reserved", "outstanding_reserved_units"), ("credit", "service_credit_total"), ("epoch", "epoch"),
)


def line() -> Column:
    """A report as one line of text."""
    return F.concat_ws(" ", *[F.concat(F.lit(label + "="), F.expr(column).cast("string")) for label, column in LINE])


def wait_percentiles(waits: DataFrame, column: str = "wait_ticks", shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row per share: the value at place floor(share * (n - 1) + 0.5) of all values in order."""
    spread = waits.groupBy(c(column).alias("value")).agg(F.count(F.lit(1)).alias("_times"))
    block = F.floor(c("value") / 4096)
    sizes = spread.groupBy(block.alias("_block")).agg(F.sum("_times").alias("_n"))  # one row for each block of values
    upto = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("n"))
    inside = F.sum("_times").over(Window.partitionBy("_block").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = spread.withColumn("_block", block).join(sizes, "_block").withColumn("upto", c("_before") + inside)
    asked = ranked.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    place = F.floor(c("share") * (c("n") - 1) + 0.5)
    return asked.filter((place >= c("upto") - c("_times")) & (place < c("upto"))).select("share", c("value").cast("long").alias("value"))
