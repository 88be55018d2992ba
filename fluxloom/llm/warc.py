"""WARC archives with an index of every record, and reads of selected records by coalesced byte ranges.

Each record is a gzip member of its own in a file below the shared folder. Writing returns the index first: file, offset,
length, URL and digest of each record. Reading sorts the selected records by file and offset, joins neighbours into
ranges, reads each range at once, and takes the records out of it.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import Workspace, id_type, map_batches, workers_find_us

LEAST_BYTES = 100
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Bytes of archives that one task reads, and that it reads at least where there are cores for more tasks.
TASK_BYTES, LEAST_TASK_BYTES = 128 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
_CONTROL = r"[\x00-\x1f\x7f]|^ | $"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(value: object) -> str:
    """A value on one line; ``_value`` undoes it."""
    return re.sub(r"[\x00-\x1f\x7f%]|^ | $", lambda m: f"%{ord(m[0]):02X}", str(value))


def _value(header: str | None) -> str | None:
    return None if header is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), header)


def record(kind: str, page: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, date: str = DATE) -> bytes:
    """One record, not compressed. A revisit has the response's HTTP header, which tells the payload's length, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _header(page))}>", f"WARC-Date: {date}"]
    # a URL's own percent signs stand as they are; only one that holds control characters is also given in full
    lines += [f"WARC-Target-URI: {re.sub(_CONTROL, lambda m: f'%{ord(m[0]):02X}', url)}"] if url is not None else []
    lines += [f"Target-As-Given: {_header(url)}"] if url is not None and re.search(_CONTROL, url) else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"Page-Id: {_header(page)}"] if page is not None else []
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _header(refers_to))}>", f"Refers-To-Page-Id: {_header(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC header, the HTTP header and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: dict(x.split(": ", 1) for x in b.decode().split("\r\n")[1:] if ": " in x)
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_warc(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes page_id, url, payload, digest, record_type, refers_to and returns the index; save it before use, for each
    evaluation writes files anew (under names of their own, so that a repeated task leaves none half-written)."""

    def make():
        state: dict = {"out": None, "file": None, "at": 0}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            filesystem, base = _open(folder)
            files, offsets, lengths = [], [], []
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for page, url, payload, digest, kind, refers in zip(*columns, strict=True):
                if state["out"] is None:
                    filesystem.create_dir(base)
                    state["file"] = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    state["out"], state["at"] = filesystem.open_output_stream(f"{base}/{state['file']}", compression=None), 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = packer.compress(record(kind.as_py(), page.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), refers.as_py())) + packer.flush()
                state["out"].write(raw)
                files.append(state["file"])
                offsets.append(state["at"])
                lengths.append(len(raw))
                state["at"] += len(raw)
                if state["at"] >= file_bytes:
                    state["out"].close()
                    state["out"] = None
            if state["out"] is not None:
                state["out"].flush()
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column(1), batch.column(3), batch.column(0)], ["file", "offset", "length", "url", "digest", "page_id"])

        def close() -> None:
            if state["out"] is not None:
                state["out"].close()
                state["out"] = None

        step.close = close
        return step

    workers_find_us(records.sparkSession)

    def run(batches):
        step = make()
        try:
            for batch in batches:
                if batch.num_rows:
                    yield step(batch)
        finally:
            step.close()

    return records.mapInArrow(run, f"file string, offset long, length long, url string, digest string, page_id {id_type(records, 'page_id')}")


def ranges(offsets: list[int], lengths: list[int], most: int = RANGE_BYTES, gap: int = GAP_BYTES) -> list[tuple[int, int, int, int]]:
    """Sorted records joined into (first record, record after the last, offset, end)."""
    found: list[list[int]] = []
    for k, (at, n) in enumerate(zip(offsets, lengths, strict=True)):
        if found and at - found[-1][3] <= gap and at + n - found[-1][2] <= most:
            found[-1][1], found[-1][3] = k + 1, at + n
        else:
            found.append([k, k + 1, at, at + n])
    return [tuple(x) for x in found]


def read_warc(index: DataFrame, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Records of the selected rows of an index: page_id, url, record_type, payload_bytes, payload_digest, refers_to
    (ids as strings), payload (of responses). A payload that doesn't have its digest is an error. An index without rows
    gives none, and a row that repeats gives its record each time."""

    def make():
        filesystem, base = _open(folder)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            out = []
            starts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
            for low, high in zip(starts, starts[1:]):
                if low == high:
                    continue
                with filesystem.open_input_file(f"{base}/{files[low]}") as source:
                    for first, after, at, end in ranges(offsets[low:high], lengths[low:high]):
                        held = source.read_at(end - at, at)
                        for k in range(low + first, low + after):
                            raw = held[offsets[k] - at : offsets[k] - at + lengths[k]]
                            warc, http, payload = parse(zlib.decompress(raw, 31))
                            digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                            if warc["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{files[k]} at {offsets[k]}: the payload doesn't have its digest")
                            out.append((_value(warc.get("Page-Id")), _value(warc["Target-As-Given"]) if "Target-As-Given" in warc else warc.get("WARC-Target-URI"), warc["WARC-Type"], int(http["Content-Length"]), digest, _value(warc.get("Refers-To-Page-Id")), payload if warc["WARC-Type"] == "response" else None))
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names) if out else None

        return step

    picked = index.select("file", "offset", "length")
    # tasks are dealt by the archives' bytes: the index itself is small
    total = picked.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / task_bytes), min(index.sparkSession.sparkContext.defaultParallelism, total // LEAST_TASK_BYTES))
    picked = picked.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return map_batches(picked, make, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """Writes a record per row of ``pages`` and returns the saved index and the folder.

    Null payloads are empty. Of equal payloads of at least ``least_bytes`` bytes the smallest id (nulls last) is the
    response, the others revisit it; rows that repeat that id are responses too. Other columns are not read.
    """
    ws = Workspace(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 AND response IS NOT NULL").drop("n")
    joined = rows.join(ws.save(first, "first"), "digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    records = joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))
    folder = f"{ws.path}/archive"
    return ws.save(write_warc(records, folder), "index"), folder


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` and reads every record back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    index, folder = archive(pages, id_col, url_col, html_col)
    kind = id_type(pages, id_col)
    return read_warc(index, folder).selectExpr(f"cast(page_id AS {kind}) AS page_id", "payload_bytes", "payload_digest", "record_type", f"cast(refers_to AS {kind}) AS refers_to", "url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS r FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> r THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> r THEN r END AS refers_to
FROM m
"""
