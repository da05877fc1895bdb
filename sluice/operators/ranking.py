"""The strict total order of candidates: urgency tier, priority, deadline, fair stamp, weight, id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.digests import fnv
from sluice.functions.scalars import first_match, saturating_add, stamp_cost, ticks_between
from sluice.policy import Policy
from sluice.sources.shared import written

c = F.col
#: Columns of the order, most significant first; weight counts down, a missing deadline comes last.
KEY = ("tier", "rank", "key_deadline", "key_stamp", "weight", "flow_id", "generation")


def tier(policy: Policy, now: int) -> Column:
    """0 urgent by deadline, 1 starving, 2 short of its minimum service, 3 otherwise."""
    urgent = F.lit(policy.deadline_ordering) & F.coalesce(ticks_between(F.lit(now), c("deadline_tick")) <= policy.deadline_urgency_ticks, F.lit(False))
    starving = c("ever_ready") & (ticks_between(c("eligible_since_tick"), F.lit(now)) >= policy.starvation_bound_ticks)
    short = F.lit(policy.min_service_guarantee) & (c("min_service") > 0) & (c("min_service_delivered") < c("min_service"))
    return first_match([(urgent, F.lit(0)), (starving, F.lit(1)), (short, F.lit(2))], F.lit(3))


def with_key(flows: DataFrame, priorities: DataFrame, policy: Policy, now: int) -> DataFrame:
    """flows with tier, rank (0 where the class is unknown), key_deadline and key_stamp."""
    ranks = priorities.select("priority_id", "rank")
    rows = flows.drop("rank").join(ranks, "priority_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)).cast("long"))
    return rows.withColumn("tier", tier(policy, now)).withColumn("key_deadline", c("deadline_tick") if policy.deadline_ordering else F.lit(None).cast("long")).withColumn("key_stamp", c("virtual_finish") if policy.weighted_fairness else F.lit(0).cast("long"))


def ordering() -> list[Column]:
    return [c("tier"), c("rank"), c("key_deadline").asc_nulls_last(), c("key_stamp"), c("weight").desc(), c("flow_id"), c("generation")]


def order_struct() -> Column:
    """The key as one comparable value: a smaller one goes first."""
    return F.struct(c("tier"), c("rank"), F.coalesce(c("key_deadline"), F.lit((1 << 63) - 1)).alias("d"), c("key_stamp"), (-c("weight")).alias("w"), c("flow_id"), c("generation"))


def key_digest() -> Column:
    """A digest of the key: tier and rank in four bytes each, a missing deadline as the greatest number, the weight as what is left above it."""
    return fnv(c("tier"), c("rank"), F.coalesce(c("key_deadline"), F.lit(-1)), c("key_stamp"), F.bitwise_not(c("weight")), c("flow_id"), c("generation"), widths=(4, 4, 8, 8, 8, 8, 8))


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """rows with their place, from 1, in the order of all.

    The order is cut into ranges that are sorted in parallel; only the sizes of the ranges meet in one task.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    laid, _ = written(laid, "numbered")  # so that the ranges stay as they are
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return laid.join(F.broadcast(before), "_part").withColumn(name, (c("_before") + c("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_part", "_at", "_before")


def positions(flows: DataFrame, limit: int | None = None) -> DataFrame:
    """flows with position, from 1, in the order of all; with a limit only the first so many."""
    if limit is not None:
        return flows.orderBy(*ordering()).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*ordering())).cast("long"))
    return numbered(flows, ordering())


def fair_stamps(entering: DataFrame, clocks: DataFrame, policy: Policy) -> DataFrame:
    """Flows that become ready with the stamp they get: the later of their own and their group's, plus what their quantum costs."""
    rows = entering.join(clocks.select("fairness_group", "clock"), "fairness_group", "left")
    start = F.greatest(c("virtual_finish"), F.coalesce(c("clock"), F.lit(0)))
    cost = stamp_cost(F.least(c("service_quantum"), F.lit(policy.max_quantum)), c("weight"))
    return rows.withColumn("stamp", saturating_add(start, cost))


def group_clocks(granted: DataFrame) -> DataFrame:
    """Each group's virtual time: the latest stamp granted in it."""
    return granted.groupBy("fairness_group").agg(F.max("virtual_finish").alias("clock"))


def min_service_window(now: int) -> tuple[Column, Column]:
    """(start, delivered) of the lazily reset window of a flow that becomes ready."""
    begin = c("min_service_window_start")
    anew = (c("min_service") > 0) & (~c("ever_ready") | (F.lit(now) < begin) | (F.lit(now) - begin >= c("min_service_window")))
    return F.when(anew, F.lit(now)).otherwise(begin), F.when(anew, F.lit(0)).otherwise(c("min_service_delivered"))
