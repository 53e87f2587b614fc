"""WARC archives with a two-level capture index.

Writing: every page becomes one record, compressed as a member of its own, so that a reader can
start at any record. Of pages with one payload the first is a response and the others are
revisits of it. Tasks write straight to shared storage through Arrow's file systems, under names
of their own attempt; the rows they return name the files that count.

The index sorts captures by reversed-host URL key over all tasks. Each task cuts its range into
compressed blocks and keeps a sparse directory, the first key and the byte range of each block.

Reading: an URL key is placed in the ranges that may hold it, found in the range's directory by
binary search, and in the block that one range read brings. The captures found are then dealt
out by stretch of archive, sorted, and read in byte ranges that join neighbouring records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import scratch_root, stage
from .rows import LAST_ID, order_id

#: Captures in a block of the index.
BLOCK_LINES = 1000
#: Bytes after which a task goes on in a new archive.
ARCHIVE_BYTES = 1 << 30
#: Bytes of an archive that one task reads, and the largest gap that one range read bridges.
STRETCH, GAP = 16 << 20, 16 << 10
#: Parts that a response shared by many pages is split into when roles are joined.
SALTS = 32
LEVEL = 6
#: Bytes of record payloads in an Arrow batch.
BATCH = 8 << 20

# fixed values: the archive format
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRLF = b"\r\n"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``http://www.a.example:80/x?y#z`` gives ``example,a,www)/x?y``.

    Scheme, user, port and fragment do not count, and the host is lower case. A null URL has the empty key.
    """
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    rest = F.regexp_extract(url, pattern, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.coalesce(key, F.lit(""))


# --- storage ---------------------------------------------------------------------------------


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][A-Za-z0-9+.\-]+:", uri) else f"file://{uri}")


class Ranges:
    """Byte ranges of files; the last file stays open."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = storage(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.file, self.name = self.fs.open_input_file(posixpath.join(self.root, name)), name
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name, self.file = None, None


class Writer:
    """Compressed members one after the other in files of a bounded size."""

    def __init__(self, folder: str, stem: str, ending: str, limit: int, head: bytes = b"") -> None:
        self.fs, self.root = storage(folder)
        self.stem, self.ending, self.limit, self.head = stem, ending, limit, head
        self.number, self.file, self.at, self.name = 0, None, 0, ""

    def put(self, data: bytes) -> tuple[str, int, int]:
        """Name of the file, offset and length of the new member."""
        if self.file is None:
            self.name = f"{self.stem}-{self.number:05d}{self.ending}"
            self.file, self.at = self.fs.open_output_stream(posixpath.join(self.root, self.name), compression=None), 0
            self.number += 1
            if self.head:
                self.put(self.head)
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.file.write(member)
        start, self.at = self.at, self.at + len(member)
        name = self.name
        if self.at >= self.limit:
            self.close()
        return name, start, len(member)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None


def _attempt(kind: str) -> str:
    """A name that no other attempt of a task has."""
    return f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"


# --- records ---------------------------------------------------------------------------------


def header_value(text: str) -> str:
    """Text on one header line: blanks and control characters as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: quote(m[0]), text)


def record_id(number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'capture:{number}')}>"


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


@dataclass(frozen=True)
class Capture:
    """One record: a response with its payload, or a revisit of another record."""

    number: int
    page_id: int | None
    url: str | None
    digest: str
    size: int
    payload: bytes | None
    refers_to: int | None = None
    refers_to_page: int | None = None


def record(c: Capture, date: str) -> bytes:
    revisit = c.payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {c.size}\r\n\r\n".encode()
    block = http + (c.payload or b"")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(c.number)), ("WARC-Date", date)]
    if c.url is not None:
        fields.append(("WARC-Target-URI", header_value(c.url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{c.digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(c.refers_to))]
        if c.refers_to_page is not None:
            fields.append(("X-Refers-To-Page", str(c.refers_to_page)))
    if c.page_id is not None:
        fields.append(("X-Page", str(c.page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + CRLF + CRLF


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def parsed(data: bytes) -> dict:
    """Fields of one record, and its page's payload size and digest."""
    head, _, rest = data.partition(CRLF + CRLF)
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": int(fields["X-Page"]) if "X-Page" in fields else None,
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(_fields(http)["Content-Length"]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None,
        "payload": None if revisit else payload,
    }


# --- writing ---------------------------------------------------------------------------------

CAPTURES = "key string, number bigint, archive string, start bigint, length bigint"


def _batches(rows: Iterator[tuple], schema: str, weight=lambda row: 200) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        size += weight(row)
        if size > BATCH:
            yield batch()
            held, size = [], 0
    yield batch()


def _roles(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """Staged pages with their number and digests, and for all but the first of one payload the record it repeats."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    named = pages.select(F.monotonically_increasing_id().alias("number"), order_id("page_id").alias("_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    # equal payloads agree in both digests; the second one is there for made-up collisions of the first
    named = named.withColumns({"size": F.length("payload").cast("long"), "sha1": F.sha1("payload"), "same": F.unhex(F.sha2("payload", 256))})
    named = stage(named, "pages")
    same = named.where(F.col("size") >= min_revisit_bytes)
    first = same.groupBy("same").agg(F.min(F.struct("_id", "number")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = same.select("number", "same", F.pmod("number", F.lit(SALTS)).cast("int").alias("salt")).join(first, ["same", "salt"])
    # one narrow row per revisit, keyed by the page's own number: where they are few, Spark joins without moving a payload
    again = stage(again.where("first.number != number").select("number", F.col("first.number").alias("refers_to"), F.col("first._id").alias("refers_to_id")), "revisits")
    return named.join(again, "number", "left").select(
        "number", "_id", "url", "sha1", "size", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        "refers_to", "refers_to_id", url_key(F.col("url")).alias("key"),
    )


def write_records(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> DataFrame:
    """Archives of all rows of ``pages(page_id, url, html)`` in ``folder``; returns where each capture lies (``CAPTURES``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: trialgauge\r\nformat: WARC File Format 1.0\r\n"
        head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        out = Writer(folder, _attempt("pages"), ".warc.gz", ARCHIVE_BYTES, head.encode() + info + CRLF + CRLF)
        known = lambda i: None if i is None or i == LAST_ID else i

        def rows() -> Iterator[tuple]:
            for batch in batches:
                # one payload at a time leaves Arrow's memory
                for i in range(batch.num_rows):
                    number, page, url, sha1, size, payload, first, first_id, key = (batch.column(c)[i].as_py() for c in range(9))
                    made = Capture(number, known(page), url, base32(sha1), size, payload, first, known(first_id))
                    yield (key, number, *out.put(record(made, date)))

        yield from _batches(rows(), CAPTURES)
        out.close()

    return stage(_roles(pages, min_revisit_bytes).mapInArrow(run, CAPTURES), "captures")


# --- index -----------------------------------------------------------------------------------

PARTS = "part int, first string, last string, file string, directory_start bigint, directory_length bigint"


@dataclass(frozen=True)
class Index:
    """An archive folder with its index; ``parts`` has one row per index file, at most one per shuffle partition."""

    folder: str
    parts: DataFrame


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sort captures by key into compressed blocks, each index file ending in its sparse directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = Writer(folder, _attempt("index"), ".cdx.gz", 1 << 62)
        directory: list[tuple[str, int, int]] = []
        lines: list[list] = []
        last = None

        def flush() -> None:
            if lines:
                _, start, length = out.put("\n".join(map(json.dumps, lines)).encode())
                directory.append((lines[0][0], start, length))
                lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(list(row))
                last = row[0]
                if len(lines) == block_lines:
                    flush()
        flush()
        if directory:
            file, start, length = out.put(json.dumps(directory).encode())
            yield from _batches(iter([(part, directory[0][0], last, file, start, length)]), PARTS)
        out.close()

    ordered = captures.repartitionByRange("key", "number").sortWithinPartitions("key", "number")
    return Index(folder, stage(ordered.mapInArrow(run, PARTS), "index"))


def _unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has: their rows are short, but each stands for a read of storage."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


FOUND = "key string, number bigint, archive string, start bigint, length bigint"


def locate(index: Index, keys: DataFrame) -> DataFrame:
    """Captures (``FOUND``) of every key of ``keys(key)``.

    The ranges of the index files are as many as the shuffle has partitions, whatever the number
    of captures; a key that fills several files is looked up in each of them.
    """
    files = sorted((tuple(r) for r in index.parts.collect()), key=lambda r: r[0])
    firsts, lasts = [r[1] for r in files], [r[2] for r in files]
    folder = index.folder

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    for at in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                        yield (key, at)

        yield from _batches(rows(), "key string, at int")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)

        def rows() -> Iterator[tuple]:
            now, directory, starts, held, block, names = None, [], [], None, [], []
            for batch in batches:
                for key, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at != now:
                        file, start, length = files[at][3:]
                        directory = json.loads(_unpacked(ranges.read(file, start, length)))
                        now, starts, held = at, [d[0] for d in directory], None
                    # the key may begin in the block before the first one that starts with it
                    for b in range(max(0, bisect.bisect_left(starts, key) - 1), bisect.bisect_right(starts, key)):
                        if b != held:
                            block = [json.loads(x) for x in _unpacked(ranges.read(file, *directory[b][1:])).split(b"\n")]
                            held, names = b, [x[0] for x in block]
                        for i in range(bisect.bisect_left(names, key), bisect.bisect_right(names, key)):
                            yield tuple(block[i])

        yield from _batches(rows(), FOUND)
        ranges.close()

    placed = keys.select("key").where("key is not null").distinct().mapInArrow(place, "key string, at int")
    return placed.repartition(_tasks(keys), "at").sortWithinPartitions("at", "key").mapInArrow(find, FOUND)


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def fetch(found: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records (``RECORDS``) of the captures that ``locate`` found, read in joined byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)

        def read(wanted: list[tuple[int, int]], archive: str) -> Iterator[tuple]:
            begin = wanted[0][0]
            data = memoryview(ranges.read(archive, begin, wanted[-1][0] + wanted[-1][1] - begin))
            for start, length in wanted:
                values = parsed(_unpacked(data[start - begin : start - begin + length]))
                yield tuple(values[f.split()[0]] if with_payload or f != "payload binary" else None for f in RECORDS.split(", "))

        def rows() -> Iterator[tuple]:
            wanted: list[tuple[int, int]] = []
            now = None
            for batch in batches:
                for archive, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if wanted and (archive != now or start - sum(wanted[-1]) > GAP or start - wanted[0][0] > BATCH):
                        yield from read(wanted, now)
                        wanted = []
                    now = archive
                    wanted.append((start, length))
            if wanted:
                yield from read(wanted, now)

        yield from _batches(rows(), RECORDS, lambda row: 200 + len(row[-1] or b""))
        ranges.close()

    stretch = F.floor(F.col("start") / STRETCH)
    dealt = found.select("archive", "start", "length").repartition(_tasks(found), "archive", stretch).sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(run, RECORDS)


def write_archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, block_lines: int = BLOCK_LINES) -> Index:
    """Archives and index of all rows of ``pages(page_id, url, html)``.

    A null html is an empty payload, a null URL a record without a target under the empty key, and a
    null page id a record without one, ordered last. Pages that repeat an id and a payload are ordered
    by their place in the table; each row has its own record. Other columns are ignored. An empty
    table gives an index without parts. ``folder`` is a URI every executor reaches; unset, a new
    one under ``spark.checkpoint.dir``.
    """
    folder = folder or f"{scratch_root(spark)}/trialgauge/archive-{uuid.uuid4().hex}"
    fs, root = storage(folder)
    fs.create_dir(root, recursive=True)
    return write_index(write_records(pages, folder, min_revisit_bytes=min_revisit_bytes), folder, block_lines)


def read_urls(index: Index, urls: DataFrame, with_payload: bool = True) -> DataFrame:
    """All captures (``RECORDS``) of every URL of ``urls(url)``; a null URL asks for records without a target."""
    return fetch(locate(index, urls.select(url_key(F.col("url").cast("string")).alias("key"))), index.folder, with_payload)
