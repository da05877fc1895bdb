"""Completion evidence as a stream: each micro-batch runs the batch operator against the attempts as the batches before left them.

Late and stale reports are answered with a row, never dropped by a watermark.
Answers are written under their batch's number and replaced if the batch is run
again, so every report is answered once even if a batch is repeated.  They lie
apart by disposition, so a batch reads only what was applied before it, and of
each attempt the digest of the report that closed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators import completion

c = F.col
ANSWER = "sequence long, attempt_id long, flow_id long, code string, credited long, lifecycle_after string, outcome string, served long, digest string, disposition string, batch long"


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers so far."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ANSWER)
    return spark.read.schema(ANSWER).parquet(path)


def _after(attempts: DataFrame, state: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts and flows once the applied answers count."""
    told = applied.select("attempt_id", "flow_id", c("served").alias("_served"), c("digest").alias("_digest"), c("credited").alias("_credit"))
    closed = attempts.join(told.select("attempt_id", "_served", "_digest", "_credit"), "attempt_id", "left")
    hit = c("_served").isNotNull()
    closed = closed.withColumn("state", F.when(hit, "committed").otherwise(c("state"))).withColumn("evidence_served", F.when(hit, c("_served")).otherwise(c("evidence_served"))).withColumn("credited", F.when(hit, c("_credit")).otherwise(c("credited"))).withColumn("evidence_digest", F.when(hit, c("_digest")).otherwise(c("evidence_digest")))
    by_flow = told.groupBy("flow_id").agg(F.sum("_credit").alias("_credit"))
    flows = state.join(by_flow, "flow_id", "left").withColumn("served_work", c("served_work") + F.coalesce("_credit", F.lit(0))).withColumn("open_attempt", F.when(c("_credit").isNull(), c("open_attempt")))
    return closed.select(attempts.columns), flows.select(state.columns)


def commit_batch(batch: DataFrame, number: int, attempts: DataFrame, state: DataFrame, path: str, epoch: int, now: int) -> None:
    """Answer one micro-batch and write the answers under its number."""
    spark = batch.sparkSession
    before = answers(spark, path).filter((c("disposition") == "applied") & (c("batch") < number))
    attempts, state = _after(attempts, state, before)
    told = completion.dispositions(batch, attempts, state, epoch, now).join(batch.select("sequence", "outcome", "served", completion.evidence_digest().alias("digest")), "sequence")
    told.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("disposition", "batch").parquet(path)


def start(evidence: DataFrame, attempts: DataFrame, state: DataFrame, path: str, checkpoint: str, epoch: int, now: int) -> StreamingQuery:
    """A query that answers a stream of evidence into path until its source is drained."""
    run = lambda batch, number: commit_batch(batch, number, attempts, state, path, epoch, now)
    return evidence.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
