"""What the operators share: tables, the shared folder, and hashing of text in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.sources.shared import drop_path, exists, new_path, shared_dir, written

__all__ = ["drop_path", "exists", "new_path", "shared_dir", "written"]  # the shared folder, for the operators here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any store works."""
    light_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows handed to a Python worker at once, and Spark's own setting that this replaces.
BATCH_BYTES, DEFAULT_BYTES = 8 << 20, 64 << 20


def light_batches(spark: SparkSession) -> None:
    """Hand rows to Python in small batches, unless the session says otherwise: both sides hold several batches a task, outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, str(DEFAULT_BYTES)).rstrip("b") == str(DEFAULT_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def sampled_ids(rows: DataFrame, group: str, sizes: dict, count: int, id_col: str) -> DataFrame:
    """(group, id) of at most count rows for each of a few values of group, of which sizes has the numbers of rows: those whose ids have the least hashes.

    A share of the hashes that holds count of a value's rows all but surely is kept by the scan; only what passes is ranked.
    """
    kind = rows.schema[group].dataType
    share = [(value, min(1.0, (count + 6 * count**0.5 + 10) / n)) for value, n in sizes.items()]
    shares = rows.sparkSession.createDataFrame(share, T.StructType([T.StructField(group, kind), T.StructField("_share", T.DoubleType())]))
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) / float(1 << 32)
    near = rows.select(group, id_col).join(F.broadcast(shares), group).filter(place < F.col("_share"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(place, id_col))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= count).select(group, id_col).distinct()


def sampled_texts(docs: DataFrame, chosen: DataFrame, group: str, id_col: str, text_col: str) -> list[tuple]:
    """(value of group, id, whole text) of the chosen ids, sorted; of an id's several texts the least."""
    texts = docs.filter(F.octet_length(text_col) > 0).join(F.broadcast(chosen.select(F.col(id_col).alias("_id")).distinct()), F.col(id_col) == F.col("_id"), "left_semi")
    texts = texts.groupBy(id_col).agg(F.min(text_col).alias("_text"))
    return sorted((r[group], r[id_col], r["_text"]) for r in texts.join(F.broadcast(chosen), id_col).collect())


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between stages, and what it keeps is the executor's loss; likewise the driver after training."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Odd multiplier of the polynomial hash, its inverse modulo 2**64, and the mixer's constants.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


#: A pseudo-random 64-bit word for each byte value.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of BASE or of its inverse, extended when a longer text comes."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = self.known[-1:] * self.base  # an array, so that it wraps without a warning
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


POWERS, INVERSES = Powers(BASE), Powers(BASE_INVERSE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span data[start:end] of a byte array; equal spans have equal hashes wherever they lie."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_WORDS[data] * POWERS.upto(len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * INVERSES.upto(len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width consecutive word hashes, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + words[k : k + n]
    return mix(out)


#: Bits of a bitmap of keys: a fixed size, so that it can be sent to all tasks; the more keys, the more others pass it too.
FILTER_BITS = 1 << 25
#: What so many tasks at most send is merged before it meets the rest.
MERGED_FIRST = 16


def bitmap(keys: DataFrame, column: str) -> bytes:
    """A bitmap in which the bit (key mod FILTER_BITS) of each key of a long column is set.

    Tasks send the parts of the bitmap in which they set bits, which are joined part by part, first side by side; the driver gets each part once, so neither grows with the keys.
    """
    part_bits = 1 << 16

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            own[batch["bit"].to_numpy(np.int64)] = True
        parts = np.packbits(own.reshape(-1, part_bits), axis=1)
        used = np.flatnonzero(parts.any(1))
        yield pd.DataFrame({"part": used, "side": TaskContext.get().partitionId() % MERGED_FIRST, "bits": [parts[k].tobytes() for k in used]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": frame["part"][:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in frame["bits"]]).tobytes()]})

    found = keys.select(F.pmod(F.col(column), F.lit(FILTER_BITS)).alias("bit")).mapInPandas(bits, "part long, side int, bits binary")
    for by in (("part", "side"), ("part",)):
        found = found.groupBy(*by).applyInPandas(join, "part long, bits binary")
    out = np.zeros((FILTER_BITS // part_bits, part_bits // 8), np.uint8)
    for row in found.toLocalIterator():  # at most FILTER_BITS / 8 bytes in all
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def in_bitmap(held: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys of a 64-bit array may be among those of the bitmap."""
    bit = keys.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    bits = np.frombuffer(held, np.uint8)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 == 1
