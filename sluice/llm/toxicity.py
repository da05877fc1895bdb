"""Toxicity by subword-bag embeddings.

A text is read as words; the subwords of a word are its character n-grams,
marked at the word's ends and hashed to buckets.  Each bucket has an embedding;
the embeddings of all subwords in a span of a few words are averaged into a
linear softmax, and embeddings and softmax are trained jointly in numpy.  As a
misspelling shares most n-grams with the word it stands for, it lies near it
even if it was never seen.  A text's score is that of its worst span, so one
insult in a long text counts as much as in a short one.

Training knows only labels of whole texts: it starts from spans drawn from each
text, then again and again keeps the worst spans of toxic texts and, as their
counterpart, the worst and some other spans of clean ones.

Edge cases: a null or empty text, and one without a word, scores as a text
without evidence does; repeated rows give repeated results; an empty table
gives no rows; null ids are kept; null labels are not trained on, of an id's
several labels the largest counts and of its texts the least; if a class
has no example every score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import give_back, light_batches, sampled_ids, sampled_texts

#: Bound of the training sample: texts of each class, taken whole.
SAMPLE_DOCS = 1500
#: Bounds of the spans that a text of the sample gives to a round of training: drawn in the first; after it the worst ones of a toxic text, and of a clean one the worst and as many others.
FIRST_SPANS, TOXIC_SPANS, CLEAN_SPANS = 24, 2, 6
SIZES, BUCKET_BITS, DIM, SPAN_WORDS = (3, 4, 5, 6), 18, 8, 2
ROUNDS, BATCH, RATE = 5, 512, 0.5
#: Every such text of the sample sets the threshold instead of the weights.
HELD_EVERY = 5
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_LETTER = np.array([chr(b).isalnum() or b == 39 if b < 128 else True for b in range(256)])


def normal(text: str | None) -> np.ndarray:
    """The bytes of a text in lower case, all that separates words as spaces, a space at both ends."""
    raw = np.frombuffer(b" " + (text or "").encode().translate(_LOWER) + b" ", np.uint8)
    upper = np.zeros(len(raw), np.uint8)
    upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    return np.where(_IS_LETTER[raw], raw + upper * np.uint8(32), np.uint8(32))


def subwords(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the bucket of the n-gram at each position, and whether one lies there.

    An n-gram may begin or end with a space, which marks the word's end, but holds none within.
    """
    letter = data != 32
    code = data.astype(np.uint32)
    rolled = code[:-1] * np.uint32(0x01000193) + code[1:] if len(code) > 1 else code[:0]
    inner = letter[1:]
    for size in range(3, max(SIZES) + 1):
        n = len(data) - size + 1
        if n <= 0:
            return
        rolled = rolled[:n] * np.uint32(0x01000193) + code[size - 1 :]
        inner = (inner[:n] & letter[size - 2 : size - 2 + n]) if size > 3 else letter[1 : 1 + n]
        if size in SIZES:
            mixed = (rolled ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(32 - BUCKET_BITS)), inner


def word_starts(data: np.ndarray) -> np.ndarray:
    """Positions of the spaces before words."""
    letter = data != 32
    return np.flatnonzero(letter[1:] & ~letter[:-1])


def spans(data: np.ndarray, width: int = SPAN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (positions) of every span of width words, one for each word but the last few."""
    starts = word_starts(data)
    if not len(starts):
        return starts, starts
    width = min(width, len(starts))
    ends = np.append(starts[1:], len(data))
    return starts[: len(starts) - width + 1], ends[width - 1 :]


class Bags:
    """The spans of one text, as bucket ids of each."""

    def __init__(self, text: str | None):
        data = normal(text)
        self.starts, self.ends = spans(data)
        at, ids = [], []
        for buckets, there in subwords(data):
            found = np.flatnonzero(there)
            at.append(found)
            ids.append(buckets[found])
        at, ids = (np.concatenate(at), np.concatenate(ids)) if at else (np.empty(0, np.int64), np.empty(0, np.uint32))
        order = np.argsort(at, kind="stable")
        at, self.ids = at[order], ids[order]
        self.lo, self.hi = np.searchsorted(at, self.starts), np.searchsorted(at, self.ends)
        full = self.hi > self.lo
        self.lo, self.hi = self.lo[full], self.hi[full]


class Model:
    """Embeddings of the buckets and the softmax over their mean."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
        self.out, self.bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
        self.sums = [np.full_like(x, 1e-6) for x in (self.embed[:, 0], self.out, self.bias)]

    def step(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """One Adagrad step on a batch of spans; every span has a subword."""
        (used, ids), sizes = np.unique(np.concatenate(bags), return_inverse=True), np.array([len(b) for b in bags])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        embed, sums = self.embed[used], self.sums[0][used]
        mean = np.add.reduceat(embed[ids], first, axis=0) / sizes[:, None]
        logits = mean @ self.out + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p *= (weights / weights.sum())[:, None]
        back = np.repeat((p @ self.out.T) / sizes[:, None], sizes, axis=0)
        grad = np.stack([np.bincount(ids, back[:, k], minlength=len(used)) for k in range(DIM)], 1)
        sums += (grad**2).mean(1)
        self.sums[0][used] = sums
        self.embed[used] = embed - RATE * grad / np.sqrt(sums)[:, None]
        for x, g, s in ((self.out, mean.T @ p, self.sums[1]), (self.bias, p.sum(0), self.sums[2])):
            s += g**2
            x -= RATE * g / np.sqrt(s)

    def weights(self) -> np.ndarray:
        """What a subword of each bucket adds to the margin of label 1 over label 0."""
        return self.embed @ (self.out[:, 1] - self.out[:, 0])

    def margins(self, bag: Bags, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[bag.ids])])
        return (sums[bag.hi] - sums[bag.lo]) / (bag.hi - bag.lo) + (self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], seed: int = 7) -> dict:
    """A model's parameters from labelled texts, as plain arrays: weights of buckets, bias, scale and shift."""
    model, y = Model(seed), np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return {"weights": np.zeros(1 << BUCKET_BITS, np.float32), "bias": 0.0, "scale": 0.0, "shift": -1e9, "floor": 0.0}
    bags = [Bags(t) for t in texts]
    rng = model.rng
    held = np.arange(len(y)) % HELD_EVERY == 0
    if not (y[held] == 1).any() or not (y[held] == 0).any() or not (y[~held] == 1).any() or not (y[~held] == 0).any():
        held = np.zeros(len(y), bool)  # too few examples to spare any
    for turn in range(ROUNDS):
        weights, chosen, marks = model.weights(), [], []
        for bag, label, spared in zip(bags, y, held, strict=True):
            n = len(bag.lo)
            if not n or spared:
                continue
            if turn == 0:
                pick = rng.permutation(n)[:FIRST_SPANS]
            else:
                worst = np.argsort(-model.margins(bag, weights))
                pick = worst[:TOXIC_SPANS] if label else np.concatenate([worst[:CLEAN_SPANS], rng.permutation(n)[:CLEAN_SPANS]])
            chosen += [bag.ids[bag.lo[k] : bag.hi[k]] for k in pick]
            marks += [int(label)] * len(pick)
        marks = np.array(marks)
        share = np.where(marks == 1, 0.5 / max(1, (marks == 1).sum()), 0.5 / max(1, (marks == 0).sum())) * len(marks)
        order = rng.permutation(len(marks))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            model.step([chosen[i] for i in own], marks[own], share[own])
    weights = model.weights()
    floor = float(np.median([m.max() for b, v in zip(bags, y, strict=True) if v == 0 and len(m := model.margins(b, weights))] or [0.0]))
    worst = np.array([m.max() if len(m := model.margins(b, weights)) else floor for b in bags])
    # a text is called toxic beyond the threshold that errs least on the texts held back, halfway to the next value
    used = held if held.any() else ~held
    own, marks = worst[used], y[used]
    order = np.argsort(own)
    errors = np.concatenate([[0], np.cumsum(marks[order] == 1)]) + np.concatenate([np.cumsum((marks[order] == 0)[::-1])[::-1], [0]])
    ranked = np.concatenate([[own.min() - 1], own[order], [own.max() + 1]])
    best = np.flatnonzero(errors == errors.min())
    at = best[len(best) // 2]
    cut = (ranked[at] + ranked[at + 1]) / 2
    spread = max(1e-3, float(np.std(worst[y == 0])), 0.1 * float(np.std(worst)))
    return {"weights": weights.astype(np.float32), "bias": float(model.bias[1] - model.bias[0]), "scale": 1.0 / spread, "shift": -float(cut) / spread, "floor": floor}


def score(text: str | None, model: dict) -> float:
    """The score of one whole text: of its worst span."""
    data = normal(text)
    lo, hi = spans(data)
    best = model["floor"]
    if len(lo):
        value, count = np.zeros(len(data) + 1), np.zeros(len(data) + 1)
        for buckets, there in subwords(data):
            n = len(there)
            value[1 : n + 1] += model["weights"][buckets] * there
            count[1 : n + 1] += there
        np.cumsum(value, out=value)
        np.cumsum(count, out=count)
        held = count[hi] - count[lo]
        if (held > 0).any():
            best = float(((value[hi] - value[lo])[held > 0] / held[held > 0]).max()) + model["bias"]
    return float(1 / (1 + np.exp(-np.clip(model["scale"] * best + model["shift"], -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """A model from a bounded sample of the labelled rows that satisfy keep (a condition on the id)."""
    known = labels.filter(keep & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    sizes = {r["_label"]: r["count"] for r in known.filter(F.col("_label").isin(0, 1)).groupBy("_label").count().collect()}
    found = sampled_texts(docs.select(id_col, text_col), sampled_ids(known, "_label", sizes, SAMPLE_DOCS, id_col), "_label", id_col, text_col)
    model = train([x[2] for x in found], [x[0] for x in found])
    del found
    give_back()
    return model


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with score and predicted."""
    light_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([score(t, held.value) for t in batch], dtype=float)
            give_back()

    told = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    names = [F.col(c) for c in docs.columns if c not in ("score", "predicted")]
    return docs.withColumn("score", told(F.col(text_col))).select(*names, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
