"""WARC archives with revisit resolution.

Headers (page, payload digest and length) are shuffled by digest, records that repeat a payload are joined to the
record with the smallest page id, and archives are written in which these are revisit records with fresh headers and
no payload.  Records are gzip members of their own; archives go to the shared folder through pyarrow's file systems.
A file carries its task attempt in its name and counts only if that attempt's manifest row was committed, so lost
executors and repeated attempts leave neither gaps nor doubles.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, guarded

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 512_000_000  # after which a task begins a new archive
READ_BYTES = 128_000_000  # of archives for one reading task
_NAMES = uuid.UUID("6f0b54a2-2a0c-4c2e-9a7e-0c1d8a2f7b11")  # of record ids


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def response_id(page_id: int | None, digest: str) -> str:
    """Record id of the response that holds a payload: the same wherever it is computed, so revisits can name it."""
    return uuid.uuid5(_NAMES, f"{page_id}/{digest}").urn


def record(
    page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None,
    revisit: bool, date: str, own_id: str,
) -> bytes:
    """One WARC record, uncompressed.  The HTTP header states the length of the full payload in either case; a revisit
    needs no payload.  Page ids travel in a header of our own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    number = lambda i: "none" if i is None else str(i)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{own_id if revisit else response_id(page_id, digest)}>",
        "WARC-Date": date,
        "WARC-Target-URI": _line(url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": number(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{response_id(refers_to, digest)}>", "X-Refers-To-Page-ID": number(refers_to)}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items())]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(pid, sha, first, tied): pages whose payload of min_bytes or more an earlier page has, and tied pages.

    first is the smallest id with the payload.  A null id comes after all others.  tied marks ids that occur more than
    once with the payload while being its first: one of these rows is the response, the rest revisit it.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    heads = pages.select(F.col(id_col).cast("long").alias("pid"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("size"))
    heads = durable(heads.groupBy("pid", "sha", "size").agg(F.count("*").alias("copies")), "warc-heads").where(F.col("size") >= min_bytes)
    groups = heads.groupBy("sha").agg(F.min("pid").alias("first"), F.sum("copies").alias("n")).where("n > 1")
    # A payload that very many pages share is one row of the stored groups; see common.guarded() on hot keys.
    met = heads.join(durable(groups.select("sha", "first"), "warc-groups"), "sha")
    own = F.col("pid").eqNullSafe(F.col("first"))
    return met.where(~own | (F.col("copies") > 1)).select("pid", "sha", "first", own.alias("tied"))


def _tied(src: DataFrame) -> DataFrame:
    """Records of tied rows.  Only heads are kept to choose the response of each (pid, sha); its payload is taken from
    any of the rows, which are alike, and all others need none."""
    rows = src.select("pid", "url", "sha", "size", "first", F.monotonically_increasing_id().alias("row"))
    rows = durable(rows, "warc-tied")  # so a row keeps its number
    chosen = durable(rows.groupBy("pid", "sha").agg(F.min("row").alias("row")), "warc-chosen")
    is_chosen = rows["pid"].eqNullSafe(chosen["pid"]) & (rows["sha"] == chosen["sha"]) & (rows["row"] == chosen["row"])
    again = rows.join(chosen, is_chosen, "left_anti").select("pid", "url", F.lit(None).cast("binary").alias("payload"), "sha", "size", "first", F.lit(True).alias("again"))
    payloads = src.groupBy("pid", "sha").agg(F.max("payload").alias("payload"))
    of = payloads.select(F.col("pid").alias("p2"), F.col("sha").alias("s2"), "payload")
    first = rows.join(chosen, is_chosen, "left_semi").join(of, F.col("pid").eqNullSafe(F.col("p2")) & (F.col("sha") == F.col("s2")))
    return again.unionByName(first.select("pid", "url", "payload", "sha", "size", "first", F.lit(False).alias("again")))


def write(
    pages: DataFrame, folder: str, min_bytes: int = 0, date: str | None = None, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row of pages to archives under folder; returns the manifest (file, records, bytes).

    Headers are fresh: records get ids of their own, and the time of writing unless date says another.  Null payloads
    are empty, null URLs an empty header, null ids `none`; ids are whole numbers, by contract; repeated rows are records
    of their own.  Payloads are written whole, however long.  Extra columns are ignored.  An empty table makes no archive.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    marks = durable(revisits(pages, min_bytes, id_col, payload_col), "warc-revisits")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("pid"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    src = src.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    key = marks.select(F.col("pid").alias("p2"), F.col("sha").alias("s2"), "first", "tied")
    met = src.join(guarded(key), F.col("pid").eqNullSafe(F.col("p2")) & (F.col("sha") == F.col("s2")), "left")
    columns = ["pid", "url", "payload", "sha", "size", "first"]
    out = met.where(F.coalesce(~F.col("tied"), F.lit(True))).select(*columns, F.col("s2").isNotNull().alias("again"))
    if marks.where("tied").limit(1).count():
        out = out.unionByName(_tied(met.where("tied").select(*columns)))
    out = out.withColumn("payload", F.when(~F.col("again"), F.col("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}" if task else uuid.uuid4().hex
        file, n, size, done = None, 0, 0, []
        for b in batches:
            for pid, url, payload, sha, length, first, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file is None:
                    path = f"{name}-{len(done):04d}.warc.gz"
                    file, n, size = store.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = _packed(record(pid, url, payload, length, digest, first, again, date, uuid.uuid4().urn))
                file.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    file.close()
                    done.append((path, n, size))
                    file = None
        if file is not None:
            file.close()
            done.append((path, n, size))
        if done:
            columns = zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["file", "records", "bytes"])

    return durable(out.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an uncompressed stream; header names in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, date string"


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives in the manifest; digests and lengths of responses are taken from their payloads."""

    def number(told: str) -> int | None:
        return None if told == "none" else int(told)

    def row(file: str, head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head["warc-type"] == "revisit"
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        told = head["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and (size != len(payload) or told != digest_of(payload)):
            raise ValueError(f"{file}: a payload of {len(payload)} bytes isn't the one announced, {size} bytes, {told}")
        refers_to = number(head["x-refers-to-page-id"]) if revisit else None
        return number(head["x-page-id"]), head["warc-target-uri"], size, told, head["warc-type"], refers_to, head["warc-date"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in records(stream):
                        rows.append(row(file, head, block))
                        if len(rows) >= 5000:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

    files, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(files, max(manifest.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))))
    return manifest.select("file").repartition(tasks, "file").mapInArrow(run, READ)
