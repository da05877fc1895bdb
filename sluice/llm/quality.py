"""Quality by hierarchical empirical Bayes.

A classifier of single documents (logistic regression on counts of what makes
text look like text) gives each document evidence.  Grouped sums of it give
every path a posterior that is shrunk toward its host's, which is shrunk toward
the mean of all; how strongly is estimated from how far hosts, and paths within
hosts, differ beyond chance (method of moments).  A document's score shifts its
own evidence by what its site says without it, so a site of one document says
nothing about it.

Edge cases: a null or empty text has the features of an empty one; null hosts
and paths are sites of their own; repeated rows count as documents of their
own; an empty table gives no rows; null ids are kept and null labels not
trained on; of an id's several labels the largest counts, of its texts the least; if a class has no example all evidence is 0.5; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import drop_path, sampled_ids, sampled_texts, written

#: Bound of the training sample: documents of each class, taken whole.
SAMPLE_DOCS = 3000
#: How much of a site's log odds enters a document's score; bounds of the strength of a prior, in documents.
SITE_WEIGHT, MIN_STRENGTH, MAX_STRENGTH = 0.5, 2.0, 10_000.0
_KIND = np.array([1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in (32, 10, 9, 13) else 6 if b in (44, 46) else 5 for b in range(256)])


def features(text: str | None) -> list[float]:
    """Shares and logarithms that tell prose from noise: case, digits, symbols, repetition, word and line lengths."""
    text = text or ""
    raw = text.encode()
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    top = seen.most_common(1)[0][1] / n if words else 0.0
    tails = sum(not (b := w[-1:]).isalnum() and b < b"\x80" and b not in b".," for w in words) / n
    return [1.0, *kinds[1:].tolist(), len(seen) / n, again, top, tails, len(set(lines)) / max(1, len(lines)), np.log1p(len(words)), np.log1p(len(raw) / n), np.log1p(n / max(1, len(lines))), len(seen) / np.sqrt(n)]


def train(texts: list[str], labels: list[int], rounds: int = 30, ridge: float = 1.0) -> dict:
    """Logistic regression on standardised features, by Newton's method."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return {"mean": None}
    x = np.array([features(t) for t in texts])
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[0], spread[0] = 0.0, 1.0
    z, w = np.clip((x - mean) / spread, -5, 5), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, z.T @ (y - p) - ridge * w)
    return {"mean": mean, "spread": spread, "weights": w}


def evidence(text: str | None, model: dict) -> float:
    if model["mean"] is None:
        return 0.5
    z = np.clip((np.array(features(text)) - model["mean"]) / model["spread"], -5, 5)
    return float(np.clip(1 / (1 + np.exp(-np.clip(z @ model["weights"], -30, 30))), 0.001, 0.999))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """A model of single documents from a bounded sample of the labelled rows that satisfy keep."""
    known = labels.filter(keep & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    sizes = {r["_label"]: r["count"] for r in known.filter(F.col("_label").isin(0, 1)).groupBy("_label").count().collect()}
    found = sampled_texts(docs.select(id_col, text_col), sampled_ids(known, "_label", sizes, SAMPLE_DOCS, id_col), "_label", id_col, text_col)
    return train([x[2] for x in found], [x[0] for x in found])


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, count: str, total: str, square: str, prior: Column) -> float:
    """Documents that the prior of a group is worth: from how far group means stray from their prior beyond what chance within groups explains."""
    mean = F.col(total) / F.col(count)
    within = F.greatest(F.col(square) - F.col(count) * mean * mean, F.lit(0.0))
    told = groups.filter(F.col(count) > 1).select(F.col(count).alias("n"), (F.col(count) * (mean - prior) ** 2).alias("between"), within.alias("within"), (prior * (1 - prior)).alias("spread"))
    row = told.agg(F.sum("n").alias("n"), F.count("n").alias("groups"), F.sum("between").alias("between"), F.sum("within").alias("within"), F.avg("spread").alias("spread")).first()
    if not row["groups"]:
        return MAX_STRENGTH
    noise = row["within"] / max(1, row["n"] - row["groups"])
    variance = (row["between"] - row["groups"] * noise) / row["n"]
    return float(np.clip(row["spread"] / variance - 1, MIN_STRENGTH, MAX_STRENGTH)) if variance > 0 else MAX_STRENGTH


def score(docs: DataFrame, model: dict, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: the id, evidence, host_mean and path_mean (posteriors without the document), score, keep."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([evidence(t, held.value) for t in batch], dtype=float)

    told = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(host.cast("string"), F.lit("\0")).alias("_host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("_path"), told(F.col(text_col)).alias("evidence"))
    rows, rows_path = written(rows, "evidence")
    sums = lambda frame, p: frame.agg(F.count("evidence").alias(f"_n{p}"), F.sum("evidence").alias(f"_s{p}"), F.sum(F.col("evidence") * F.col("evidence")).alias(f"_q{p}"))
    paths, paths_path = written(sums(rows.groupBy("_host", "_path"), "p"), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_np").alias("_nh"), F.sum("_sp").alias("_sh"), F.sum("_qp").alias("_qh"))
    whole = hosts.agg(F.sum("_sh").alias("s"), F.sum("_nh").alias("n")).first()
    mean = min(max((whole["s"] or 0.5) / (whole["n"] or 1), 0.001), 0.999)
    by_host = strength(hosts, "_nh", "_sh", "_qh", F.lit(mean))
    host_mean = lambda own: (F.col("_sh") - own + by_host * mean) / (F.col("_nh") - (own > 0).cast("int") + by_host)
    sites = paths.join(hosts, "_host")
    by_path = strength(sites, "_np", "_sp", "_qp", host_mean(F.lit(0.0)))
    out = rows.join(sites, ["_host", "_path"])
    out = out.withColumn("host_mean", host_mean(F.col("evidence")))
    out = out.withColumn("path_mean", (F.col("_sp") - F.col("evidence") + by_path * F.col("host_mean")) / (F.col("_np") - 1 + by_path))
    bound = lambda c: F.greatest(F.least(c, F.lit(0.999)), F.lit(0.001))
    out = out.withColumn("score", 1 / (1 + F.exp(-(logit(F.col("evidence")) + SITE_WEIGHT * (logit(bound(F.col("path_mean"))) - logit(F.lit(mean)))))))
    out, _ = written(out.select(id_col, "evidence", "host_mean", "path_mean", "score", (F.col("score") >= 0.5).alias("keep")), "quality")
    drop_path(docs.sparkSession, rows_path, paths_path)
    return out
