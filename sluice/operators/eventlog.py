"""The event log: gaps, census, and folds to the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def gaps(log: DataFrame) -> DataFrame:
    """(sequence, expected) where a record does not follow the one before it.

    Each record looks for its predecessor by an anti join, so no task sees the whole log; the first record follows nothing.
    """
    first = log.agg(F.min("sequence").alias("sequence"))
    follows = log.select((c("sequence") + 1).alias("sequence"))
    alone = log.select("sequence").distinct().join(follows, "sequence", "left_anti").join(first, "sequence", "left_anti")
    block = F.floor(c("sequence") / 1_000_000)
    tops = log.groupBy(block.alias("_b")).agg(F.max("sequence").alias("_top"))  # one row for each million records
    before = tops.withColumn("_before", F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_before")
    inside = log.select("sequence", block.alias("_b")).withColumn("_last", F.max("sequence").over(Window.partitionBy("_b").orderBy("sequence").rangeBetween(Window.unboundedPreceding, -1)))
    return inside.join(alone, "sequence", "left_semi").join(before, "_b").select("sequence", (F.coalesce("_last", "_before") + 1).alias("expected")).distinct()


def census(log: DataFrame) -> DataFrame:
    """(type, records, first_sequence, last_sequence) of the log."""
    return log.groupBy("type").agg(F.count("sequence").alias("records"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


def latest(log: DataFrame, key: str = "flow_id") -> DataFrame:
    """(key, type, tick, epoch, sequence) of each key's last record: the state that a fold of the log leaves."""
    last = F.max_by(F.struct("type", "tick", "epoch"), "sequence")
    return log.groupBy(key).agg(last.alias("_r"), F.max("sequence").alias("sequence")).select(key, c("_r.type").alias("type"), c("_r.tick").alias("tick"), c("_r.epoch").alias("epoch"), "sequence")


def recover(log: DataFrame, snapshot_sequence: int, key: str = "flow_id") -> DataFrame:
    """(key, lifecycle, served, replayed) from the records up to a snapshot and those after it; work still open at the end is ambiguous.

    Both parts are sums and a maximum by sequence, so the log is read once and folded in the tasks first.
    """
    served = F.coalesce(F.sum(F.when(c("type") == "completion-committed", c("amount"))), F.lit(0)).cast("long")
    folded = log.groupBy(key).agg(F.max_by("type", "sequence").alias("_last"), served.alias("served"), F.count_if(c("sequence") > snapshot_sequence).alias("replayed"))
    lifecycle = F.when(c("_last") == "attempt-opened", "ambiguous").when(c("_last") == "completion-committed", "completed").when(c("_last") == "attempt-closed", "ready").when(c("_last") == "schedule-issued", "scheduled").otherwise("waiting")
    return folded.select(key, lifecycle.alias("lifecycle"), "served", "replayed")
