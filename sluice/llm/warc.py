"""WARC: write archives, normalise monolithic gzip streams, read them back.

write_archives puts many records into one gzip stream (a monolithic archive).
normalise inflates each such stream once from front to end, rewrites every
record as a gzip member of its own, and writes a sidecar index of offsets.
read_records reads normalised archives; index_entries the sidecars.

Archives are real files, written by Spark's own committer to any file system
that Spark can write to, so a lost executor only repeats its task.  Spark's
text writer ends each row with a separator; here that is the zero byte that
ends every gzip member under 16 MB (the high byte of its length), so it is
taken off the row and put back by the writer.  An archive of 16 MB or more gets
an empty member at its end, which ends in zero bytes too.

Edge cases: a null payload is empty; a null url gives no target header; a null
page id gives a record without one, never chosen as the response where another
has an id, and where none has one all are responses; of records of one page with
equal payloads the one of the greatest url is the response, and of repeated rows
one, while the rest revisit it; an empty table gives no archive and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import exists, written

#: Bytes of records after which a new archive begins; what a task holds at once.
ARCHIVE_BYTES = 12 << 20
ID_PREFIX = "urn:page:"
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, member_offset long, member_length long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def typed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, keeper (of records with equal payloads, the largest page id) and response (whether the record is the one that others revisit).

    The digests are first reduced to one row each; the payloads then meet them in a join, whose skewed partitions AQE splits.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_digest", F.sha2("payload", 256))
    key = ["_digest", "page_id", "url"]
    again, _ = written(rows.groupBy(*key).count().filter(F.col("count") > 1), "repeated")
    rows = rows.withColumn("_copy", F.lit(1))
    if not again.isEmpty():  # repeated rows are numbered, which takes a row of each and how many there are
        same = [rows[c].eqNullSafe(again[c]) for c in key]
        one = rows.join(again, same, "left_semi").dropDuplicates(key)
        copies = one.join(again.select("count", *[F.col(c).alias(f"{c}_") for c in key]), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key])
        copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).select(*rows.columns)
        rows = rows.join(again, same, "left_anti").unionByName(copies)
    keepers = rows.groupBy("_digest").agg(F.max(F.struct("page_id", "url")).alias("_top"))
    chosen = F.col("page_id").isNull() | ((F.col("page_id") == F.col("_top.page_id")) & F.col("url").eqNullSafe(F.col("_top.url")) & (F.col("_copy") == 1))
    response = F.col("_top.page_id").isNull() | (chosen & F.col("page_id").isNotNull())
    return rows.join(keepers, "_digest").select("page_id", "url", "payload", F.col("_top.page_id").alias("keeper"), response.alias("response"))


def record(page_id, url, payload: bytes, keeper, response: bool) -> bytes:
    """One WARC record: a response with the payload, or a revisit of the keeper without it."""
    revisit = not response
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID_PREFIX}{keeper}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _whole(value):
    return None if pd.isna(value) else int(value)


def _row(name: str, kind: str, data: bytes) -> dict:
    """A file's row: its bytes without the zero at their end."""
    if data[-1:] != b"\0":
        data += EMPTY_MEMBER
    return {"kind": kind, "name": name, "value": data[:-1]}


def _save(rows: DataFrame, path: str) -> None:
    """Rows (kind, name, value) as one file each, under kind=.../name=..."""
    rows.select("kind", "name", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "name").option("lineSep", "\0").text(path)


def write_archives(typed_pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Monolithic archives under path: each is one gzip stream over many records."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, size, out, stream = TaskContext.get().partitionId(), 0, 0, [], None
        for batch in batches:
            for page_id, url, payload, keeper, response in zip(*(batch[c] for c in ("page_id", "url", "payload", "keeper", "response")), strict=True):
                stream = stream or zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(_whole(page_id), url, bytes(payload), _whole(keeper), bool(response))
                out.append(stream.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield pd.DataFrame([_row(f"pages-{part:06d}-{number:06d}", "monolithic", b"".join(out) + stream.flush())])
                    number, size, out, stream = number + 1, 0, [], None
        if stream:
            yield pd.DataFrame([_row(f"pages-{part:06d}-{number:06d}", "monolithic", b"".join(out) + stream.flush())])

    _save(typed_pages.select("page_id", "url", "payload", "keeper", "response").mapInPandas(pack, "kind string, name string, value binary"), path)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file, of one member or several, in pieces, in one pass."""
    view, at = memoryview(data), 0
    stream = zlib.decompressobj(31)
    while at < len(view):
        piece = view[at : at + step]
        at += len(piece)
        while True:
            yield stream.decompress(piece)
            if not stream.eof:
                break
            piece, stream = stream.unused_data, zlib.decompressobj(31)
            if not piece:
                break


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, the record's bytes) of each WARC record of a stream."""
    held = bytearray()
    end = need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                need = end + 4 + int(headers["content-length"]) + 4
            if len(held) < need:
                break
            yield headers, bytes(held[end + 4 : need - 4]), bytes(held[:need])
            del held[:need]
            need = None
    if held.strip(b"\r\n"):
        raise ValueError("an archive ends within a record")


def _archives(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if not exists(spark, f"{path}/kind={kind}"):  # no archive was written
        return spark.createDataFrame([], "name string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/kind={kind}")
    return files.select(F.regexp_extract("path", r"/name=([^/]+)/", 1).alias("name"), "content")


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Every monolithic archive under source as one of members under target, with its index.

    Each index line is JSON: record, type, offset and length of the member.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                out, lines, at = [], [], 0
                for headers, _, whole in records(inflated(content)):
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = gz.compress(whole) + gz.flush()
                    lines.append(json.dumps({"record": headers["warc-record-id"], "type": headers["warc-type"], "offset": at, "length": len(member)}))
                    out.append(member)
                    at += len(member)
                yield pd.DataFrame([_row(name, "archive", b"".join(out)), {"kind": "index", "name": name, "value": "\n".join(lines).encode()}])

    _save(_archives(spark, source, "monolithic").mapInPandas(rewrite, "kind string, name string, value binary"), target)


def members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each member of a gzip file."""
    view, at = memoryview(data), 0
    while at < len(view):
        stream, out, to = zlib.decompressobj(31), [], at
        while not stream.eof:
            if to >= len(view):
                raise ValueError("an archive ends within a member")
            out.append(stream.decompress(view[to : to + step]))
            to = min(to + step, len(view))
        to -= len(stream.unused_data)
        yield at, to - at, b"".join(out)
        at = to


def read_members(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """The records of some index entries (archive, offset, length): only their members are inflated."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content, found in zip(batch["name"], batch["content"], batch["found"], strict=True):
                for e in found:
                    data = zlib.decompress(memoryview(content)[e["offset"] : e["offset"] + e["length"]], 31)
                    rows += [(*described(headers, block), name, e["offset"], e["length"]) for headers, block, _ in records(iter([data]))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD_SCHEMA.split(", ")], dtype=object)

    wanted = entries.groupBy(F.col("archive").alias("name")).agg(F.collect_set(F.struct("offset", "length")).alias("found"))  # at most the members of one archive
    return _archives(spark, path, "archive").join(wanted, "name").select("name", "content", "found").mapInPandas(read, RECORD_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the normalised archives under path, with where its member lies."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                rows = [(*described(headers, block), name, at, length) for at, length, data in members(content) for headers, block, _ in records(iter([data]))]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD_SCHEMA.split(", ")], dtype=object)

    return _archives(spark, path, "archive").mapInPandas(read, RECORD_SCHEMA)


def described(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, type, payload bytes, payload digest and refers_to of a record, the digest of a response taken from its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    of = lambda name: (x := headers.get(name, "")[len(ID_PREFIX) + 1 : -1]) and int(x) if name in headers else None
    page, refers = of("warc-record-id"), of("warc-refers-to")
    page = None if page == "" else page
    if headers["warc-type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return page, headers.get("warc-target-uri"), "revisit", size, headers["warc-payload-digest"].removeprefix("sha1:"), refers
    return page, headers.get("warc-target-uri"), "response", len(payload), sha1_base32(payload), None


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """archive, record, type, offset, length: the sidecar indexes under path."""
    lines = F.explode(F.split(F.translate(F.col("content").cast("string"), "\0", ""), "\n"))
    entry = F.from_json("line", "record string, type string, offset long, length long")
    return _archives(spark, path, "index").select(F.col("name").alias("archive"), lines.alias("line")).filter(F.length("line") > 0).select("archive", entry.alias("e")).select("archive", "e.*")


ORACLE = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h, max(page_id) OVER (PARTITION BY sha1(payload)) AS keeper FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(1 + 5 * i + j AS BIGINT), 1) AS BIGINT) << (4 - j))) AS BIGINT), 1)), '') AS payload_digest,
        CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM (SELECT *, CAST(CAST(unhex(h) AS BIT) AS VARCHAR) AS bits FROM d)
    """
