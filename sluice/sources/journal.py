"""A journal of framed records: magic, format, type, sequence, length and a CRC-32C over header and payload.

`encode` writes records, `decode` reads them back and tells a torn tail (the
file ends within a frame) from corruption (a frame that is whole but wrong).
`scan` decodes journal files of any store in parallel, one file a row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sluice.functions.digests import crc32c_of

MAGIC, FORMAT = 0x534C5543, 1
HEAD = struct.Struct("<IHHQI")
MAX_PAYLOAD = 1 << 20
# Record types, numbered from 1.
TYPES = (
    "resource-registered", "reservation-registered", "reservation-retired", "priority-registered", "qos-registered", "flow-admitted", "flow-updated", "flow-cancelled", "flow-readiness-changed", "flow-retired", "policy-installed",
    "epoch-advanced", "schedule-issued", "schedule-released", "attempt-opened", "attempt-started", "attempt-closed", "completion-committed", "ambiguity-resolved", "checkpoint",
)
SCANNED = "path string, sequence long, type string, payload binary, tail string"


def encode(records: Iterable[tuple[int, str, bytes]]) -> bytes:
    """Frames of (sequence, type, payload)."""
    out = bytearray()
    for sequence, kind, payload in records:
        if len(payload) > MAX_PAYLOAD:
            raise ValueError("a payload exceeds the bound")
        head = HEAD.pack(MAGIC, FORMAT, TYPES.index(kind) + 1, sequence, len(payload))
        out += head + payload + struct.pack("<I", crc32c_of(head + payload))
    return bytes(out)


def decode(data: bytes) -> tuple[list[tuple[int, str, bytes]], str]:
    """(records, tail): tail is 'clean', 'torn', 'corrupt' or 'gap', of what follows the records."""
    found, at = [], 0
    while at < len(data):
        if at + HEAD.size > len(data):
            return found, "torn"
        magic, form, kind, sequence, size = HEAD.unpack_from(data, at)
        if magic != MAGIC or form != FORMAT or not 1 <= kind <= len(TYPES) or size > MAX_PAYLOAD:
            return found, "corrupt"
        end = at + HEAD.size + size
        if end + 4 > len(data):
            return found, "torn"
        if struct.unpack_from("<I", data, end)[0] != crc32c_of(data[at:end]):
            return found, "corrupt"
        if found and sequence != found[-1][0] + 1:
            return found, "gap"
        found.append((sequence, TYPES[kind - 1], bytes(data[at + HEAD.size : end])))
        at = end + 4
    return found, "clean"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the journal files under path, with the state of its file's tail; a file without records has one row without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                records, tail = decode(bytes(content))
                rows = [(name, s, k, p, tail) for s, k, p in records] or [(name, None, None, None, tail)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCANNED.split(", ")]).astype({"sequence": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCANNED)
