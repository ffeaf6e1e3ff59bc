"""WARC archives written index first, and read back by coalesced byte ranges.

Writing: payload digests are computed in a narrow pass; of equal payloads the smallest
page_id is the response, the others are revisits of it. Every task then writes its pages
to archive files of its own in the shared folder, and a row (file, offset, length, url,
digest) per record to the index. The index is what a reader goes by: a task that is run
again writes other files, and those of the lost attempt are never listed.

Reading: the selected index rows are dealt by ranges of (file, offset) and sorted in each
task; ranges that touch or lie within GAP bytes of each other are read at once, up to
SPAN bytes, and the records are cut out of them.

Records are stored as gzip members, one per record, so each can be read by itself.

Defined results: null html is an empty payload; a null url is an empty target; every row
gives a record and is decided by its own page_id and payload, so a repeated page_id loses
no payload; rows equal in both are one record written twice, under one Record-ID; a null
page_id is always a response, and none that others refer to; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op4_warc_roundtrip"
#: Payloads of fewer bytes are always stored whole.
REVISIT_FROM = 0
GAP, SPAN, FILE_BYTES = 64 << 10, 4 << 20, 1 << 30
#: Index rows a task of the reading stage gets on average.
READ_ROWS = 20_000
INDEX_DDL = "page_id bigint, file string, offset bigint, length bigint, url string, digest string, record_type string"
RECORD_DDL = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class Folder:
    """Files below a folder that driver and executors share, by its URI."""

    def __init__(self, uri: str):
        from pyarrow import fs

        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = uri.replace("file:", "file://", 1)
        self.fs, self.root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")

    def writer(self, name: str):
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)  # each record is packed by itself

    def reader(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")

    def make(self) -> None:
        self.fs.create_dir(self.root, recursive=True)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, more: str = "") -> str:
    """A response is named by page and payload, so that revisits can name it without seeing it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id} {digest} {more}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has no payload, but the digest and size of the full one and the page it repeats."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest) if refers_to is None else record_id(page_id, digest, f'revisit {url}')}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        f"X-Page-ID: {page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    if refers_to is not None:
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; a response's digest and size are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    payload = block.partition(b"\r\n\r\n")[2]
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "response"
    if whole and digest_of(payload) != stated:
        raise ValueError("a payload does not have its stated digest")
    refers = None if whole else fields["X-Refers-To-Page-ID"]
    return {
        "page_id": None if fields["X-Page-ID"] == "None" else int(fields["X-Page-ID"]),
        "url": fields["WARC-Target-URI"].encode().decode("unicode_escape"),
        "payload": payload if whole else None,
        "payload_bytes": len(payload) if whole else int(fields["X-Payload-Bytes"]),
        "payload_digest": digest_of(payload) if whole else stated,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
    }


def _write_kernel(folder: str):
    def run(batches):
        from pyspark import TaskContext

        task, files = TaskContext.get(), 0
        shared, out, name, at = None, None, "", 0
        for part in common.slices(batches, "html"):
            rows = {f: [] for f in ("page_id", "file", "offset", "length", "url", "digest", "record_type")}
            for page_id, url, html, refers in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), common.raw_texts(part.column("html")), part.column("refers_to").to_pylist(), strict=True):
                if out is None:
                    shared = shared or Folder(folder)
                    name, at = f"{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz", 0
                    out, files = shared.writer(name), files + 1
                payload = html or b""
                digest = digest_of(payload)
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, payload, digest, refers)) + packer.flush()
                out.write(data)
                for f, v in (("page_id", page_id), ("file", name), ("offset", at), ("length", len(data)), ("url", url), ("digest", digest), ("record_type", "response" if refers is None else "revisit")):
                    rows[f].append(v)
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[f], pa.int64() if f in ("page_id", "offset", "length") else pa.string()) for f in rows], list(rows)
            )
        if out is not None:
            out.close()

    return run


def spans(places: list[tuple[str, int, int]], gap: int = GAP, most: int = SPAN) -> list[tuple[int, int]]:
    """Runs (first, past last) of sorted (file, offset, length) that one read serves."""
    out, i = [], 0
    while i < len(places):
        file, start, size = places[i]
        end, j = start + size, i + 1
        while j < len(places) and places[j][0] == file and places[j][1] <= end + gap and max(end, places[j][1] + places[j][2]) - start <= most:
            end, j = max(end, places[j][1] + places[j][2]), j + 1
        out.append((i, j))
        i = j
    return out


def _read_kernel(folder: str, payloads: bool):
    def run(batches):
        shared, source, opened = None, None, None
        for part in batches:
            shared = shared or Folder(folder)
            places = list(zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for i, j in spans(places):
                file, start, _ = places[i]
                if file != opened:
                    if source:
                        source.close()
                    source, opened = shared.reader(file), file
                end = max(o + n for _, o, n in places[i:j])
                block = source.read_at(end - start, start)
                found = [parse(zlib.decompress(block[o - start : o - start + n], 31)) for _, o, n in places[i:j]]
                if not payloads:
                    for x in found:
                        x["payload"] = None
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if source:
            source.close()

    return run


def with_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """pages(page_id, url, html) and refers_to: the smallest page_id with the same payload, null for that one itself.
    Digests are grouped and joined in narrow rows; each row is then decided by its page_id and digest."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    digest = F.sha1(payload).alias("digest")
    narrow = pages.select("page_id", digest, F.octet_length(payload).alias("size"))
    firsts = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = narrow.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return pages.select("page_id", "url", "html", digest).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, least: int = REVISIT_FROM) -> DataFrame:
    """Archives in folder; returns their index, which is a table in the shared folder too."""
    Folder(folder).make()
    rows = with_revisits(pages, least).select(F.col("page_id").cast("bigint"), "url", "html", F.col("refers_to").cast("bigint"))
    return common.materialize(rows.mapInArrow(_write_kernel(folder), INDEX_DDL), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the given index rows."""
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-index.count() // READ_ROWS))
    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read_kernel(folder, payloads), RECORD_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    index = write(common.table(spark, sf_dir, "pages"), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (
  select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first from pages
)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(substr(
           array_to_string(list_transform(split(sha1(html), ''), lambda h:
             substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (position(h in '0123456789abcdef') - 1), 4)), ''),
           cast(1 + 5 * i as bigint), 5)::bit::int as bigint), 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from p
"""
