"""64-bit FNV-1a, CRC-32C and SplitMix64 over columns: wrapping arithmetic, done in numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# FNV-1a offset and prime, the reflected Castagnoli polynomial, SplitMix64's increment and multipliers.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
CASTAGNOLI = 0x82F63B78
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def fold_bytes(state: np.ndarray, values: np.ndarray, width: int = 8) -> np.ndarray:
    """FNV-1a states after the lowest width bytes of each value, least first."""
    for k in range(width):
        state = (state ^ ((values >> np.uint64(8 * k)) & np.uint64(0xFF))) * np.uint64(FNV_PRIME)
    return state


def fnv(*fields: Column, widths: tuple[int, ...] | None = None, listed: int | None = None) -> Column:
    """FNV-1a of whole fields in order, nulls as 0, as the digest's two's complement.

    widths: bytes of each field, 8 if not said; listed: the place of a field that is an array, which is folded in ascending
    order after its size.
    """
    sizes = widths or (8,) * len(fields)

    @F.pandas_udf(LongType())
    def digest(*columns: pd.Series) -> pd.Series:
        state = np.full(len(columns[0]), FNV_OFFSET, np.uint64)
        for place, (column, width) in enumerate(zip(columns, sizes, strict=True)):
            if place != listed:
                state = fold_bytes(state, column.to_numpy(np.int64).view(np.uint64), width)
                continue
            counts = column.map(len).to_numpy(np.int64)
            state = fold_bytes(state, counts.view(np.uint64))
            flat, starts = np.array([x for row in column for x in sorted(row)], np.int64).view(np.uint64), np.cumsum(counts) - counts
            for k in range(int(counts.max(initial=0))):
                on = np.flatnonzero(counts > k)
                state[on] = fold_bytes(state[on], flat[starts[on] + k])
        return pd.Series(state.view(np.int64))

    return digest(*[f if k == listed else F.coalesce(f.cast("long"), F.lit(0)) for k, f in enumerate(fields)])


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(CASTAGNOLI), table >> np.uint32(1))
    return table


CRC_TABLE = crc_table()


def crc32c_of(data: bytes, seed: int = 0) -> int:
    """CRC-32C of bytes."""
    crc = seed ^ 0xFFFFFFFF
    for b in data:
        crc = int(CRC_TABLE[(crc ^ b) & 0xFF]) ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of a binary column, all rows a byte further at a time."""
    raw = [bytes(x) for x in data]
    sizes = np.array([len(x) for x in raw], np.int64)
    flat, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
    crc = np.full(len(raw), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        on = np.flatnonzero(sizes > k)
        crc[on] = CRC_TABLE[(crc[on] ^ flat[starts[on] + k]) & np.uint32(0xFF)] ^ (crc[on] >> np.uint32(8))
    return pd.Series((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64))


class SplitMix:
    """The SplitMix64 sequence of a seed, in whole numbers."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFFFFFFFFFF

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & 0xFFFFFFFFFFFFFFFF
        z = self.state
        z = ((z ^ (z >> 30)) * MIX_A) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * MIX_B) & 0xFFFFFFFFFFFFFFFF
        return z ^ (z >> 31)

    def below(self, bound: int) -> int:
        """A draw below bound, without bias: draws in the last incomplete run are thrown away."""
        limit = (1 << 64) - (1 << 64) % bound
        while (draw := self.next()) >= limit:
            pass
        return draw % bound

    def chance(self, share: float) -> bool:
        """True in that share of draws."""
        return self.next() >> 11 < int(share * (1 << 53))
