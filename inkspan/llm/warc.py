r"""WARC archives with a two-level capture index.

Writing.  Each page becomes one WARC record in a gzip member of its own.  Of pages
with equal payloads (SHA-1 and length) the one with the largest page_id is a
response, the others are revisit records that name it and hold no payload.  Tasks
write archive files of about FILE_BYTES bytes into the shared folder under names of
their own, so a repeated task leaves only files that nothing refers to.

Index.  Captures are range-partitioned and sorted by reversed-host URL key and
page_id.  Each partition is an index file: compressed blocks of BLOCK captures, then
a sparse directory (first capture of each block, offset, length) and its length.
Level one, kept as a table, is the first capture of each index file.

Look-up.  A key finds its index file by binary search among the files' first
captures, its block by binary search in that file's directory, and its record by one
range read in the archive.  Records are read in order of file and offset.

Defined results: null html is an empty payload and null urls are empty; a null
page_id is a capture of its own that never is what others refer to; repeated rows
with the largest page_id are all responses; an empty table gives no archive and no
rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, parts as slices, shared_dir, table

BLOCK = 512
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)


def url_key(url: Column) -> Column:
    """Reversed host, `)`, then path and query; without scheme, fragment, user and port."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record holds; the digest of a response is computed from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda x: None if x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    revisit = fields["WARC-Type"] == "revisit"
    size = int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload)
    digest = fields["WARC-Payload-Digest"][len("sha1:") :] if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None}


class _Files:
    """Range reads from files of one folder, keeping the last one open."""

    def __init__(self, folder: str) -> None:
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self._open(name).read_at(length, offset)

    def size(self, name: str) -> int:
        return self._open(name).size()

    def _open(self, name: str):
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.root}/{name}")
        return self.file

    def writer(self, name: str):
        self.system.create_dir(self.root, recursive=True)
        return self.system.open_output_stream(f"{self.root}/{name}", compression=None)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns the captures: key, pid, file, offset, length."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", url_key(F.col("url")).alias("key"), payload.alias("payload"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    # one short row per payload, written, so that AQE may split the pages of a very common payload over tasks
    first = cut(rows.groupBy("sha", "size").agg(F.max("page_id").alias("response")))
    typed = rows.join(first, ["sha", "size"]).select("page_id", "url", "key", "payload", "sha", "response", (F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]):
        files, out, name, at = _Files(folder), None, None, 0
        for b in slices(batches):
            offsets, lengths, names = [], [], []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at > FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.writer(name)
                digest = base64.b32encode(bytes.fromhex(r[4])).decode()
                member = gzip.compress(record(r[0], r[1], r[3], digest, r[5], r[6]), 1, mtime=0)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                names.append(name)
                at += len(member)
            pid = pa.array([NO_ID if x is None else x for x in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(2), pid, pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "pid", "file", "offset", "length"])
        if out:
            out.close()

    return cut(typed.mapInArrow(run, "key string, pid long, file string, offset long, length long"))


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, int, str]]:
    """Writes the index files; returns (first key, first pid, file) of each, sorted."""
    ordered = captures.repartitionByRange("key", "pid").sortWithinPartitions("key", "pid", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]):
        files, out, name, at, directory, lines, heads = _Files(folder), None, f"index-{uuid.uuid4().hex}", 0, [], [], []

        def flush():
            nonlocal out, at
            if out is None:
                out = files.writer(name)
            block = gzip.compress(("\n".join(lines) + "\n").encode(), 6, mtime=0)
            directory.append([*heads[0], at, len(block)])
            out.write(block)
            at += len(block)
            lines.clear()
            heads.clear()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                heads.append(r[:2])
                lines.append(json.dumps(r))
                if len(lines) == BLOCK:
                    flush()
        if lines:
            flush()
        if out:
            tail = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])], names=["key", "pid", "file"])

    # one row per index file
    return sorted((r["key"], r["pid"], r["file"]) for r in ordered.mapInArrow(run, "key string, pid long, file string").collect())


def lookup(wanted: DataFrame, folder: str, parts: list[tuple[str, int, str]]) -> DataFrame:
    """The captures of the wanted (key, pid), or of all pids of a key where pid is null."""
    heads, names = [(k, p) for k, p, _ in parts], [x for _, _, x in parts]
    low = F.coalesce("pid", F.lit(NO_ID))
    asked = wanted.select("key", "pid").distinct().repartitionByRange("key", low).sortWithinPartitions("key", low)

    def run(batches: Iterator[pa.RecordBatch]):
        files = _Files(folder)
        directories: dict[int, list] = {}
        blocks: dict[tuple, list] = {}

        def directory(i: int) -> list:
            if i not in directories:
                directories.clear()  # look-ups come in order
                size = files.size(names[i])
                n = int.from_bytes(files.read(names[i], size - 8, 8), "big")
                directories[i] = json.loads(gzip.decompress(files.read(names[i], size - 8 - n, n)))
            return directories[i]

        def block(i: int, k: int) -> list:
            if (i, k) not in blocks:
                if len(blocks) > 3:
                    blocks.pop(next(iter(blocks)))
                _, _, offset, length = directory(i)[k]
                blocks[i, k] = [json.loads(x) for x in gzip.decompress(files.read(names[i], offset, length)).decode().splitlines()]
            return blocks[i, k]

        for b in batches:
            found = []
            for key, pid in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lo, hi = (key, NO_ID if pid is None else pid), (key, (1 << 63) - 1 if pid is None else pid)
                i = max(bisect.bisect_left(heads, lo) - 1, 0)
                while i < len(names) and (heads[i] <= hi):
                    d = directory(i)
                    k = max(bisect.bisect_left(d, [*lo]) - 1, 0)
                    while k < len(d) and tuple(d[k][:2]) <= hi:
                        found += [x for x in block(i, k) if lo <= (x[0], x[1]) <= hi]
                        k += 1
                    i += 1
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "pid", "file", "offset", "length"), x, strict=True)) for x in found], schema=schema)

    schema = pa.schema([("key", pa.string()), ("pid", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    return asked.mapInArrow(run, "key string, pid long, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    ordered = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]):
        files = _Files(folder)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [parse(gzip.decompress(files.read(*x))) for x in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return ordered.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[str, list[tuple[str, int, str]]]:
    """Writes archives and index; returns their folder and the index files."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return folder, write_index(write_archives(pages, folder), folder)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    folder, parts = archive(pages)
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.coalesce("page_id", F.lit(NO_ID)).alias("pid"))
    found = read_records(lookup(wanted, folder, parts), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
g AS (SELECT x, max(page_id) AS top FROM h GROUP BY x),
bits AS (SELECT x, top, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', x[i]) - 1), 4, '0')), '') AS s FROM g),
d AS (SELECT x, top, array_to_string(list_transform(range(0, 32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * cast(s[5 * i + 1] AS int) + 8 * cast(s[5 * i + 2] AS int) + 4 * cast(s[5 * i + 3] AS int) + 2 * cast(s[5 * i + 4] AS int) + cast(s[5 * i + 5] AS int)]), '') AS digest FROM bits)
SELECT page_id, cast(n AS bigint) AS payload_bytes, digest AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM h JOIN d USING (x)
"""
