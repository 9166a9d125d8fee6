"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record and returns where each lies. Equal payloads are stored once: the
capture with the largest page id is the response, the others become revisit records that refer to it.
``build_index`` sorts captures by reversed-host URL key (``com,example)/path``) into compressed blocks of
``BLOCK_LINES`` lines; each index file ends with its sparse directory, one line a block. A table with the first and last key of
every index file is the level above. ``lookup`` finds the file of a key there, binary-searches that file's directory,
then the block, and ``read_captures`` reads the byte ranges found, in archive order.

Files go through ``pyarrow.fs`` to the folder that executors share, under a new name for each task attempt; only
captures that a finished task returned are in the index, so a lost executor leaves unreferenced files at most.

Defined cases: a null html is an empty payload; a null URL has the empty key; a null page id ranks below all others
and is written as ``null``; rows that repeat id and payload have the same record type; payloads under ``min_bytes``
are always responses; an empty table makes an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_folder, materialize, new_path, salted_left_join, table, texts_of

BLOCK_LINES, MIN_BYTES = 1_000, 0
#: An archive file is closed beyond this size; ranges closer than GAP are read at once, up to READ bytes.
ARCHIVE_BYTES, GAP, READ = 1 << 30, 1 << 16, 8 << 20
#: The date of captures without one.
DATE = "2024-01-01T00:00:00Z"
ENTRY = "key string, page_id long, file string, offset long, length long"
FIELDS = ["key", "page_id", "file", "offset", "length"]


def open_file(path: str, write: bool = False):
    system, name = pa.fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    return system.open_input_file(name)


def url_key(url: str | None) -> str:
    """Reversed-host key: host labels from the top level down, port, path and query; no scheme, user or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return quote(url, safe="/:?&=,)%")
    host = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return quote(f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""), safe="/:?&=,)%+;@!$*()~")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC record: the HTTP response, or for revisits its header alone."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe='/:?&=,)%+;@!$*()~#')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the HTTP response, payload."""

    def headers(raw: bytes) -> dict[str, str]:
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in raw.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, headers(http), payload


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages under ``path``; the captures as a stored table of ``ENTRY``.

    Record types are settled on ids and digests alone; the payloads are shuffled once, by id and digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    slim = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "sha")
    owner = slim.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("m")).where("m > 1").drop("m")
    # Many pages may have one payload, as the empty one: they are dealt to several tasks.
    others = salted_left_join(slim.distinct(), owner, "sha", "page_id").where("owner is not null and not (page_id <=> owner)").select(F.col("page_id").alias("pid"), F.col("sha").alias("s"), "owner")
    rows = rows.join(others, (rows["sha"] == others["s"]) & rows["page_id"].eqNullSafe(others["pid"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
            for page_id, url, owner, payload in zip(*columns, texts_of(batch.column(2)), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{path}/archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = open_file(name, write=True)
                member = gzip.compress(record(page_id, url, payload, None if owner is None else str(owner)), 4, mtime=0)
                out.write(member)
                found.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            yield _entries(found)
        if out is not None:
            out.close()

    return materialize(rows.select("page_id", "url", "html", "owner").mapInArrow(run, ENTRY), "captures")


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], FIELDS)


def build_index(captures: DataFrame, path: str) -> DataFrame:
    """The level above: a stored table of ``file, first, last, entries``, one row an index file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, directory, lines, n, last = f"{path}/index-{uuid.uuid4().hex}.cdx.z", None, 0, [], [], 0, ""

        def block() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append((lines[0].partition("\t")[0], at, len(data)))
            out.write(data)
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or open_file(name, write=True)
                lines.append("\t".join([row[0], json.dumps(row[1:])]))
                n, last = n + 1, row[0]
                if len(lines) == BLOCK_LINES:
                    block()
        if out is None:
            return
        if lines:
            block()
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data + len(data).to_bytes(8, "big"))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([directory[0][0]]), pa.array([last]), pa.array([n], pa.int64())], ["file", "first", "last", "entries"]
        )

    ordered = captures.repartitionByRange("key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    return materialize(ordered.select(*FIELDS).mapInArrow(run, "file string, first string, last string, entries long"), "index")


class IndexFile:
    """One index file: its directory in memory, one block at a time."""

    def __init__(self, path: str):
        self.file = open_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, size - 8 - length)))
        self.firsts = [d[0] for d in self.directory]
        self.at, self.lines, self.keys = -1, [], []

    def find(self, key: str) -> Iterator[tuple]:
        """Entries of a key: bisect the directory, then the block; a key may run over several blocks."""
        b = max(0, bisect_left(self.firsts, key) - 1)
        while b < len(self.directory) and self.firsts[b] <= key:
            if b != self.at:
                _, offset, length = self.directory[b]
                self.at, self.lines = b, zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")
                self.keys = [x.partition("\t")[0] for x in self.lines]
            for i in range(bisect_left(self.keys, key), bisect_right(self.keys, key)):
                yield (key, *json.loads(self.lines[i].partition("\t")[2]))
            b += 1


def lookup(index: DataFrame, keys: DataFrame, limit: int = 100_000) -> DataFrame:
    """Captures (``ENTRY``) of the keys in column ``key``.

    The level above goes to the executors with the lookup; it has one row an index file, that is at most one for each
    shuffle partition of the build, and more than ``limit`` are refused.
    """
    top = sorted((r["first"], r["last"], r["file"]) for r in index.limit(limit + 1).collect())
    if len(top) > limit:
        raise ValueError(f"more than {limit} index files: build the index with fewer partitions")
    firsts, lasts = [t[0] for t in top], [t[1] for t in top]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k) for k in batch.column(0).to_pylist() for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], ["part", "key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            found = []
            for part, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at:
                    at, file = part, IndexFile(top[part][2])
                found += file.find(key)
                if len(found) >= 10_000:
                    yield _entries(found)
                    found = []
            yield _entries(found)

    routed = keys.select("key").distinct().mapInArrow(route, "part int, key string")
    return routed.repartition("part").sortWithinPartitions("part", "key").mapInArrow(find, ENTRY)


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_captures(captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records of captures, by range reads in archive order; digests are checked against the payloads read."""

    def number(name: str | None) -> int | None:
        name = name and name[len("<urn:page:") : -1]
        return None if name in (None, "null") else int(name)

    def row(data: bytes) -> tuple:
        fields, http, body = parse_record(gzip.decompress(data))
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and base32_sha1(body) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        size = len(body) if kind == "response" else int(http["content-length"])
        return (
            number(fields["warc-record-id"]), fields["warc-target-uri"], kind, number(fields.get("warc-refers-to")), digest, size,
            body if payload and kind == "response" else None,
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file, begin, held = None, None, 0, b""
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            rows, size = [], 0
            for i, (name, offset, length) in enumerate(places):
                if name != at:
                    at, file, begin, held = name, open_file(name), 0, b""
                if not begin <= offset <= offset + length <= begin + len(held):
                    end, j = offset + length, i + 1
                    while j < len(places) and places[j][0] == name and places[j][1] - end <= GAP and places[j][1] + places[j][2] - offset <= READ:
                        end, j = places[j][1] + places[j][2], j + 1
                    begin, held = offset, file.read_at(end - offset, offset)
                rows.append(row(held[offset - begin : offset - begin + length]))
                size += length
                if size >= READ:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    return captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Reversed-host keys of URLs, as column ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    return pages.select(url_col).mapInArrow(run, "key string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), new_path(spark, "warc")
    index = build_index(write_archives(pages, path), path)
    found = read_captures(lookup(index, keys_of(pages)), payload=False)
    found = materialize(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    delete_folder(spark, path)  # archives and index
    return found


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
  h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
  g AS (SELECT x, max(page_id) AS owner FROM h GROUP BY x),
  bits AS (SELECT page_id, x, n, array_to_string(list_transform(range(1, 41), lambda i: right(bin(CAST('0x' || substr(x, i, 1) AS INTEGER) + 16), 4)), '') AS s FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5),
    lambda j: CAST(substr(s, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM bits JOIN g USING (x)
"""
QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": ORACLE}
