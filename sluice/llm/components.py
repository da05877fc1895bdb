"""Connected components of links between ids, without collecting links anywhere.

Each task first replaces the links it holds by a forest with the same
components.  Then large-star and small-star steps alternate: each id hands its
larger neighbours, and then its smaller ones, to the least id it knows, until
every component is a star around its least id.  No step makes more links than
it is given.  Each is a grouped aggregation and a join on ids; its result is written to the shared folder,
which cuts the lineage, so a lost executor costs one step.

Edge cases: links with a null end and from an id to itself say nothing;
repeated links count once; no links give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import drop_path, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every id but the least of its component to that least one."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = flat[: len(a)], flat[len(a) :], np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), a over b, with the same components, as few as one task can make of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        size = 0
        for batch in batches:
            held[0].append(batch["a"].to_numpy(np.int64))
            held[1].append(batch["b"].to_numpy(np.int64))
            size += len(batch)
            if size > 4_000_000:  # what a task keeps: the forest so far
                a, b = forest(np.concatenate(held[0]), np.concatenate(held[1]))
                held, size = ([a], [b]), 0
        a, b = forest(np.concatenate(held[0]), np.concatenate(held[1]))
        yield pd.DataFrame({"a": a, "b": b})

    plain = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter(F.col("a") != F.col("b"))
    return plain.mapInPandas(run, "a long, b long")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    handed = links.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every id has one link downwards at most, and none both ways."""
    ends = links.select(F.col("a").alias("id"), "b", F.lit(1).alias("down")).unionByName(links.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("down")))
    seen = ends.groupBy("id").agg(F.min("down").alias("_no"), F.max("down").alias("_down"), F.min("b").alias("_least"), F.max("b").alias("_most"))
    return seen.filter((F.col("_no") < F.col("_down")) | (F.col("_least") < F.col("_most"))).isEmpty()


def connected(links: DataFrame) -> tuple[DataFrame, str]:
    """(id, component) of every id that has a link but is not the least of its component; and the path of the table."""
    spark = links.sparkSession
    now, path = written(contracted(links), "links")
    while not _stars(now):
        larger, between = written(_large_star(now), "large")
        after, next_path = written(_small_star(larger), "small")
        drop_path(spark, path, between)
        now, path = after, next_path
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).distinct(), path
