"""WARC archives: one gzip member a record, written by tasks, read back by byte ranges.

A reading task gets a byte range. It looks for the gzip magic, decodes each candidate
far enough to see a WARC header, decodes the member to its end (the checksum must hold)
and goes on behind it. It owns the records whose member starts in its range and reads
past the range's end to finish the last one. A range may start anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, save, scratch

MAGIC = b"\x1f\x8b\x08"
#: Bytes after which a writer starts the next file, bytes of a reading range, bytes read at once.
FILE_BYTES, RANGE_BYTES, READ_BYTES = 256 << 20, 4 << 20, 1 << 20
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
LEVEL = 3


def _local(uri: str) -> str | None:
    at = urllib.parse.urlparse(uri)
    return urllib.parse.unquote(at.path) if at.scheme in ("", "file") else None


def _open_out(uri: str):
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path))
        return store.open_output_stream(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "wb")


def _open_in(uri: str):
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        return store.open_input_file(path)
    return open(path, "rb")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another page's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row to new files in the shared folder; returns (path, bytes, records) of the files.

    Of rows with equal payloads of REVISIT_BYTES or more, those with the largest id
    are responses, the others revisit it; a null id is smaller than any other, and
    payloads that have null ids alone are all responses. A null payload is empty.

    Each attempt of a task writes files of its own name and reports them in its rows,
    so a file counts only if its attempt succeeded. Payloads are never shuffled unless
    the repeated digests outgrow a broadcast.
    """
    data = F.coalesce(F.col(html), F.lit("")).cast("binary")
    given = pages.select(F.col(page).cast("long").alias("id"), F.col(url).alias("url"), data.alias("payload"), F.sha1(data).alias("digest"))
    again = given.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = save(again.where("n > 1 and first is not null").select("digest", "first"), "warc-again")
    joined = given.join(lookup(again, 300_000), "digest", "left")
    joined = joined.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("to"))
    folder = scratch(pages.sparkSession, "warc")

    def run(batches):
        out, path, size, count = None, "", 0, 0
        done = []
        for b in batches:
            for i, u, p, d, to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open_out(path)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = z.compress(record(i, u, p, d, to, date)) + z.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "bytes", "records"])

    return save(joined.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class Range:
    """The records whose gzip member starts in [start, end) of a file."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end = file, start, end

    def member(self, at: int, data: bytes) -> tuple[bytes, int] | None:
        """(content, bytes) of the gzip member at ``at``, of which ``data`` is the beginning; None if it is none or holds no WARC record."""
        if len(data) < 1 << 16:
            data += self.file_read(at + len(data), READ_BYTES)
        if len(data) < 18 or data[3] & 0xE0:
            return None
        z, out, used = zlib.decompressobj(31), [], 0
        while True:
            try:
                if not used:
                    got = z.decompress(data, 4096)
                    if not got.startswith(b"WARC/1."):
                        return None
                    got += z.decompress(z.unconsumed_tail)
                else:
                    got = z.decompress(data)
            except zlib.error:
                return None
            out.append(got)
            used += len(data) - len(z.unused_data)
            if z.eof:
                return b"".join(out), used
            data = self.file_read(at + used, READ_BYTES)
            if not data:
                return None

    def file_read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __iter__(self):
        at, data = self.start, b""  # data: what the file holds from ``at``
        while at < self.end:
            if len(data) < len(MAGIC):
                data = self.file_read(at, READ_BYTES)
                if len(data) < len(MAGIC):
                    return
            i = data.find(MAGIC)
            if i < 0:
                at, data = at + len(data) - len(MAGIC) + 1, b""
                continue
            at, data = at + i, data[i:]
            if at >= self.end:
                return
            found = self.member(at, data)
            if found is None:
                at, data = at + 1, data[1:]
            else:
                content, used = found
                yield at, used, content
                at, data = at + used, data[used:]


_PAGE = re.compile(r"<urn:x-page:(-?\d+)>")


def parse(content: bytes) -> dict:
    """type, id, url, digest (hex), payload (None for a revisit), payload bytes and the id referred to."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    page, to = (_PAGE.search(fields.get(f"warc-{k}", "")) for k in ("record-id", "refers-to"))
    said = fields.get("warc-payload-digest", "")
    return {
        "type": kind, "id": int(page[1]) if page else None, "url": fields.get("warc-target-uri"), "to": int(to[1]) if to else None,
        "digest": base64.b32decode(said[5:]).hex() if said.startswith("sha1:") else None, "payload": payload if kind != "revisit" else None,
        "bytes": len(payload) if kind != "revisit" else int(length[1]) if length else 0,
    }


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The records of WARC files (path, bytes), read in ranges of ``range_bytes`` by as many tasks.

    Returns path, offset, length, record_type, page_id, url, payload_bytes,
    payload_digest (hex SHA-1: of the payload as read for responses, as stated for
    revisits), intact (that the two agree), refers_to and, if asked for, payload.
    Bytes that belong to no valid record are passed over. A range that starts inside a stored
    payload which holds a whole gzip member of a record would report that one too. Equal files are read
    as often as they are named; files without bytes have no rows; further columns are ignored. No file: no rows.
    """
    cut = F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {int(range_bytes)}L)"))
    ranges = save(files.where("bytes > 0").select("path", "bytes", cut.alias("start")), "warc-ranges")
    n = ranges.count()
    names = ["path", "offset", "length", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "intact", "refers_to"] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64()] + [pa.binary()] * payloads

    def run(batches):
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                rows, held = [], 0
                with _open_in(path) as file:
                    for at, used, content in Range(file, start, min(size, start + range_bytes)):
                        r = parse(content)
                        own = r["digest"] if r["payload"] is None else hashlib.sha1(r["payload"]).hexdigest()
                        rows.append((path, at, used, r["type"], r["id"], r["url"], r["bytes"], own, own == r["digest"], r["to"], r["payload"])[: len(names)])
                        held += r["bytes"] if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "path string, offset long, length long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, intact boolean, refers_to long" + ", payload binary" * payloads
    return ranges.repartition(max(1, min(n, 20_000)), F.xxhash64("path", "start")).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read them back: a row for each page.

    Null and empty html have an empty payload; of equal payloads of 1000 bytes or more the largest page_id is
    the response, as are rows that repeat it. Repeated ids keep their rows; further columns are ignored. Empty table: no rows.
    """
    back = read(pages.sparkSession, write(pages))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by payload_digest)
select p.page_id, cast(payload_bytes as bigint) as payload_bytes, p.payload_digest,
       case when first is not null and p.page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when first is not null and p.page_id is distinct from first then first end as refers_to
from p left join m on p.payload_digest = m.payload_digest and p.payload_bytes >= 1000
"""
