"""Why things are as they are: bounded histories and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scalars import id_text
from sluice.operators import ranking
from sluice.policy import MAX_STEPS

c = F.col


def history_tail(steps: DataFrame, key: str = "flow_id", order: str = "sequence", keep: int = MAX_STEPS) -> DataFrame:
    """(key, steps, truncated, last_type): how many of each key's newest steps are kept, whether older ones were dropped, and the newest."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(c(order).desc()))
    ranked = steps.withColumn("_rank", rank)
    return ranked.groupBy(key).agg(F.count_if(c("_rank") <= keep).alias("steps"), (F.max("_rank") > keep).alias("truncated"), F.max(F.when(c("_rank") == 1, c("type"))).alias("last_type"))


def history(steps: DataFrame, key: str = "flow_id", order: str = "sequence", keep: int = MAX_STEPS) -> DataFrame:
    """(key, history): the newest steps of each key, oldest first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(c(order).desc()))
    kept = steps.withColumn("_rank", rank).filter(c("_rank") <= keep)
    rest = [n for n in steps.columns if n not in (key, order)]
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("history"))


def entry_line() -> Column:
    """A schedule entry as one line."""
    return F.concat(c("kind"), F.lit(" "), id_text("flow", c("flow_id")), F.lit(" quantum="), c("quantum").cast("string"), F.lit(" tier="), c("tier").cast("string"), F.lit(" consumed="), c("consumed").cast("string"), F.lit(" ("), c("reason"), F.lit(")"))


def explain_flow(keyed: DataFrame, steps: DataFrame, order: str = "sequence") -> DataFrame:
    """(flow_id, generation, lifecycle, tier, ordering_digest, last_reason, steps, truncated, history) of flows with their key; steps have a reason, and history holds the newest of them, oldest first."""
    told = history(steps, order=order).withColumn("last_reason", F.element_at("history", -1)["reason"])
    count = history_tail(steps, order=order).select("flow_id", "steps", "truncated")
    rows = keyed.select("flow_id", "generation", "lifecycle", "tier", ranking.key_digest().alias("ordering_digest")).join(told, "flow_id", "left").join(count, "flow_id", "left")
    return rows.withColumns({"last_reason": F.coalesce("last_reason", F.lit("selected")), "steps": F.coalesce("steps", F.lit(0)), "truncated": F.coalesce("truncated", F.lit(False))})


def canonical(entries: DataFrame, keep: int = 256) -> DataFrame:
    """(schedule_id, runs, preempts, canonical): counts, and the first entries of each schedule in order as one text."""
    text = F.concat_ws(":", c("ordinal").cast("string"), c("kind"), c("flow_id").cast("string"), c("flow_generation").cast("string"), c("resource_id").cast("string"), c("quantum").cast("string"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("t")))), lambda x: x["ordinal"] < keep)
    return entries.groupBy("schedule_id").agg(F.count_if(c("kind") == "run").alias("runs"), F.count_if(c("kind") == "preempt").alias("preempts"), F.array_join(F.transform(kept, lambda x: x["t"]), "|").alias("canonical"))
