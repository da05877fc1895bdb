"""Sampled encoding over a SentencePiece vocabulary, and lossless decoding.

A text is a lattice whose edges are the pieces that match between two of its
positions.  The forward pass sums the probability of all ways to reach each
position (filtering); the backward pass then draws, from the end, which piece
ended there (sampling).  Draws come from a hash of the row's key, the place in
the text and a seed, so that a row has the same segmentation on every run and
every cluster.

No piece holds a space mark after another character, or a line feed, so the
lattice falls apart before spaces and around line feeds; equal parts of a
block of rows share one forward pass, and those that a task meets first share
it with its later blocks.  A character that no piece covers is
spelled by byte pieces.  The vocabulary is of the BPE kind and ranks its pieces
without probabilities; the piece of rank r gets the normalised 1 / (r + 1) of
Zipf's law, raised to a sharpness.

Nothing is normalised and a space mark within a text is spelled by bytes, so
decoding gives back every text exactly.

Edge cases: a null text has null ids and 0 tokens, an empty one no ids; a null
key draws as key 0; repeated rows are segmented alike; an empty table gives no
rows; columns named as the results are replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import BASE, INVERSES, POWERS, give_back, light_batches, mix

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL_MARK = "▁", "\ud800"  # a text that holds the mark itself has a lone surrogate, which no text can hold, in its place
PARTS = re.compile(f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Characters whose lattices are built together: what bounds a task's memory beside one text.
BLOCK_CHARS = 1 << 18
#: Characters of distinct parts whose lattices a task keeps for its later blocks; those met after that are built block by block.
KEPT_CHARS = 1 << 20
#: Probabilities are whole multiples of 1 / DRAW.
DRAW = 1 << 39


def load(path: str = MODEL_PATH) -> dict:
    """The vocabulary of a SentencePiece model file, as plain data: read once by the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by_byte, texts = {}, [0] * 256, []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            by_byte[int(piece[3:5], 16)] = k
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            texts.append(b"")
        else:
            if "\n" in piece or MARK in piece.lstrip(MARK):
                raise ValueError("a piece crosses a space or a line feed; the lattice would not fall apart there")
            pieces[piece] = (k, max(0.0, -model.get_score(k)))
            texts.append(piece.replace(MARK, " ").encode())
    if not pieces or not any(by_byte):
        raise ValueError("the model has no pieces or no byte fallback")
    return {"pieces": pieces, "by_byte": by_byte, "texts": texts}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = found = len(self)
        return found


class _Lattices:
    """Lattices of parts one behind another: a growing array of each of the six that Sampler.lattice gives."""

    TYPES = (np.int32, np.int32, np.int64, np.int32, np.int32, np.int32)

    def __init__(self):
        self.numbers = _Numbers()
        self.chars, self.sizes, self.arrays = 0, [0] * 6, [np.empty(1024, t) for t in self.TYPES]

    def followed_by(self, lattice: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], list[int]]:
        """All arrays with those of one more lattice at their ends, which stays if their new sizes are taken on."""
        base, end, keys, source, piece, low = lattice
        edges, positions = self.sizes[2], self.sizes[5]
        added = (base + positions, end + positions, keys, source + positions, piece, low + edges)
        ends = [n + len(x) for n, x in zip(self.sizes, added, strict=True)]
        for k, (n, x) in enumerate(zip(self.sizes, added, strict=True)):
            if ends[k] > len(self.arrays[k]):
                grown = np.empty(ends[k] + ends[k] // 4, self.TYPES[k])
                grown[:n] = self.arrays[k][:n]
                self.arrays[k] = grown
            self.arrays[k][n : ends[k]] = x
        return self.all(ends), ends

    def all(self, ends: list[int]) -> list[np.ndarray]:
        return [x[:n] for x, n in zip(self.arrays, ends, strict=True)]


class Sampler:
    """Forward passes and draws for one vocabulary; made once in each worker."""

    def __init__(self, vocabulary: dict, sharpness: float = 1.0, seed: int = 0):
        self.texts, self.by_byte, self.seed = vocabulary["texts"], vocabulary["by_byte"], np.uint64(seed)
        prefixes: dict[str, int] = {}
        logs = np.full(len(self.texts), -np.inf)
        total = np.log(sum(1 / (r + 1) for _, r in vocabulary["pieces"].values()))
        for piece, (k, rank) in vocabulary["pieces"].items():
            for n in range(1, len(piece)):
                prefixes.setdefault(piece[:n], -1)
            prefixes[piece] = k
            logs[k] = sharpness * (-np.log(rank + 1) - total)
        self.longest, self.lattices = max(map(len, vocabulary["pieces"])), _Lattices()
        self.logs, self.fallback_log = logs, float(logs[np.isfinite(logs)].min()) - 10.0
        keys = list(prefixes)
        lengths = np.array([len(x) for x in keys])
        flat = _codes("".join(keys))
        ends = np.cumsum(lengths)
        hashes = self._hashes(self._sums(flat), ends - lengths, ends)
        order = np.argsort(hashes)
        self.hashes, self.found = hashes[order], np.array([prefixes[x] for x in keys])[order]
        self.near = np.zeros(1 << 20, bool)
        self.near[(hashes >> np.uint64(44)).astype(np.int64)] = True
        sizes = np.array([len(t) for t in self.texts])
        self.bytes, self.sizes, self.starts = np.frombuffer(b"".join(self.texts), np.uint8), sizes, np.cumsum(sizes) - sizes
        if self.longest > 63 or (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("a piece is too long, or two piece prefixes have one hash")

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * POWERS.upto(len(codes)), out=sums[1:])
        return sums

    @staticmethod
    def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * INVERSES.upto(len(sums))[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))

    def lattice(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """For distinct parts: where each ends, and of all edges, by the position they end at: cumulated draw keys, position they come from, piece; and the first edge that ends at each position.

        A position is that of a character in the joined parts plus the number of the part, so that each part has a position before its first character.
        """
        lengths = np.array([len(p) for p in parts])
        codes = _codes("".join(parts))
        if len(codes) != lengths.sum():
            raise ValueError("a text is not valid Unicode")
        part = np.repeat(np.arange(len(parts)), lengths)
        last = np.cumsum(lengths)[part]
        sums, alive = self._sums(codes), np.arange(len(codes))
        begins, sizes, ids = [], [], []
        for size in range(1, self.longest + 1):
            alive = alive[alive + size <= last[alive]]
            if not len(alive):
                break
            hashes = self._hashes(sums, alive, alive + size)
            near = np.flatnonzero(self.near[(hashes >> np.uint64(44)).astype(np.int64)])  # most that are no prefix of a piece go here
            alive, hashes = alive[near], hashes[near]
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            alive, at = alive[known], at[known]
            piece = self.found[at]
            whole = piece >= 0
            begins.append(alive[whole])
            sizes.append(np.full(whole.sum(), size))
            ids.append(piece[whole])
            if size == 1:  # characters that no piece covers are spelled by bytes: ids below zero name the character
                bare = np.setdiff1d(np.arange(len(codes)), begins[0], assume_unique=True)
                begins.append(bare)
                sizes.append(np.ones(len(bare), np.int64))
                ids.append(-1 - codes[bare].astype(np.int64))
        begin, piece = np.concatenate(begins), np.concatenate(ids)
        end = begin + np.concatenate(sizes)
        own = part[begin]
        depth = end - (last[begin] - lengths[own])
        order = np.argsort((depth << 40) + (end << 6) + (end - begin))  # by depth, end and size: pieces have at most 63 characters, blocks fewer than 2**34
        begin, end, piece, depth, own = begin[order], end[order], piece[order], depth[order], own[order]
        source, target = begin + own, end + own
        gain = np.where(piece >= 0, self.logs[np.maximum(piece, 0)], self.fallback_log)
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        level = np.searchsorted(depth[first], np.arange(1, depth[-1] + 2))
        reach = np.zeros(len(codes) + len(parts))
        edge_ends = np.append(first, len(target))
        weight = np.empty(len(target))
        for k in range(len(level) - 1):
            a, b = level[k], level[k + 1]
            lo, hi = edge_ends[a], edge_ends[b]
            weight[lo:hi] = reach[source[lo:hi]] + gain[lo:hi]
            reach[target[first[a:b]]] = np.logaddexp.reduceat(weight[lo:hi], first[a:b] - lo)
        low = np.zeros(len(reach), np.int64)
        low[target[first]] = first
        group = np.repeat(np.arange(len(first)), np.diff(edge_ends))
        share = np.cumsum(np.rint(np.exp(weight - reach[target]) * DRAW).astype(np.int64))  # whole numbers, so that sums are the same in every block
        before = np.concatenate([[0], share])[first]
        keys = np.minimum(share - before[group], DRAW - 1)
        keys[edge_ends[1:] - 1] = DRAW
        base = np.cumsum(lengths) - lengths + np.arange(len(parts))
        return base, base + lengths, keys, source, piece, low

    def lattices_of(self, parts: list[str]) -> list[np.ndarray] | tuple[np.ndarray, ...]:
        """The lattices kept so far and behind them those of parts, the last to be numbered; they are kept, and so are their numbers, while they fit."""
        held, chars = self.lattices, sum(map(len, parts))
        if not parts:
            return held.all(held.sizes)
        found, ends = held.followed_by(self.lattice(parts))
        if held.chars + chars <= KEPT_CHARS:
            held.chars, held.sizes = held.chars + chars, ends
        else:
            for _ in parts:
                held.numbers.popitem()
        return found

    def draws(self, keys: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
        """Uniform whole numbers below DRAW for (row key, part of the text, step back from the part's end)."""
        x = mix(keys + mix(places.astype(np.uint64) * np.uint64(BASE) + np.uint64(step) + (self.seed << np.uint64(32))))
        return (x >> np.uint64(25)).astype(np.int64)

    def encode(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after another, and how many each text has."""
        if sum(map(len, texts)) > KEPT_CHARS:  # one long text stands alone
            held, self.lattices = self.lattices, _Lattices()
            try:
                return self._encoded(texts, keys)
            finally:
                self.lattices = held
        return self._encoded(texts, keys)

    def _encoded(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        words, counts, numbers = [], [], self.lattices.numbers
        kept = len(numbers)
        for text in texts:
            found = PARTS.findall(MARK + text.replace(MARK, LITERAL_MARK).replace(" ", MARK)) if text else []
            words += map(numbers.__getitem__, found)
            counts.append(len(found))
        if not words:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        begin, end, edges, source, piece, low = self.lattices_of(list(islice(reversed(numbers), len(numbers) - kept))[::-1])
        word, counts = np.array(words), np.array(counts)
        firsts = np.cumsum(counts) - counts
        place = np.arange(len(word)) - np.repeat(firsts, counts)
        row_key = np.repeat(mix(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)), counts)
        at, open_, steps, drawn = end[word], np.arange(len(word)), np.zeros(len(word), np.int64), []
        stop = begin[word]
        step = 0
        while len(open_):
            here = at[open_]
            edge, draw = low[here], self.draws(row_key[open_], place[open_], step)
            past = np.flatnonzero(edges[edge] <= draw)
            while len(past):  # the last key of a position lies above all draws
                edge[past] += 1
                past = past[edges[edge[past]] <= draw[past]]
            drawn.append((open_, piece[edge]))
            at[open_] = source[edge]
            steps[open_] += 1
            open_ = open_[at[open_] > stop[open_]]
            step += 1
        offsets = np.cumsum(steps) - steps
        out = np.empty(steps.sum(), np.int64)
        for k, (which, ids) in enumerate(drawn):
            out[offsets[which] + steps[which] - 1 - k] = ids
        sizes = np.add.reduceat(np.append(steps, 0), np.minimum(firsts, len(steps))) * (counts > 0)
        return self.spelled(out, sizes)

    def spelled(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the byte pieces of the characters that ids below zero name, and the new sizes."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids.astype(np.int32), sizes
        chars = [chr(-1 - c) for c in ids[bare].tolist()]
        spelt = [[self.by_byte[b] for b in (MARK if c == LITERAL_MARK else c).encode()] for c in chars]
        times = np.ones(len(ids), np.int64)
        times[bare] = [len(s) for s in spelt]
        out = np.repeat(ids, times)
        starts = (np.cumsum(times) - times)[bare]
        for start, s in zip(starts.tolist(), spelt, strict=True):
            out[start : start + len(s)] = s
        total = np.concatenate([[0], np.cumsum(times)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return out.astype(np.int32), np.diff(total[edges])

    def lossless(self, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether the bytes of each text's pieces are those of the text after a space."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        found = self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(sizes.sum())].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        want = [b" " + t.encode() if t else b"" for t in texts]
        return np.array([found[a:b] == w for a, b, w in zip(edges[:-1], edges[1:], want, strict=True)], bool)

    def decode(self, ids) -> str:
        """The text of piece ids."""
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, vocabulary: dict, key: str = "doc_id", text: str = "text", sharpness: float = 1.0, seed: int = 0) -> DataFrame:
    """docs with ids (array of int), n_tokens and lossless (decoding the ids gave the text back)."""
    light_batches(docs.sparkSession)
    added = ("ids", "n_tokens", "lossless")
    kept = [c for c in docs.columns if c not in added]
    source, held = docs.select(*kept), docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*source.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())])

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(batch.column(text)), 0).cast(pa.int64()))
        sums, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + BLOCK_CHARS, side="right")))
            yield batch.slice(at, to - at)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(held.value, sharpness, seed)
        for whole in batches:
            for batch in blocks(whole):
                texts = batch.column(text).to_pylist()
                ids, sizes = sampler.encode([t or "" for t in texts], [k or 0 for k in batch.column(key).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                same = sampler.lossless(ids, sizes, texts)
                nulls = pa.array(np.append([t is None for t in texts], False)) if None in texts else None
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=None if nulls is None else np.asarray(nulls)), pa.array(ids, pa.int32()))
                give_back()
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sizes, pa.int64()), pa.array(same)], names=[*batch.schema.names, *added])

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: dict, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null for null ids."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary["texts"])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        texts = held.value
        for batch in batches:
            yield pd.Series([None if x is None else b"".join(map(texts.__getitem__, x)).decode("utf-8", "replace")[1:] for x in batch], dtype=object)

    return rows.withColumn(text, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(ids)))


def encoded(spark: SparkSession, docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """docs encoded by the vocabulary of a model file that the driver reads."""
    return encode(docs, load(path))
