"""WARC archives of pages with a two-level capture index.

Pages are ordered by their key, the URL with its host reversed, and range-partitioned by it.
Each task writes one archive, every record a gzip member of its own, and beside it one index:
lines (key, page, offset, length) in order, cut into compressed blocks, then the directory
with the first key of each block. A lookup finds the archive by the first keys of all
archives, binary-searches the directory, reads one block, binary-searches its lines and reads
the record's bytes; nothing else of either file is touched.

Of records with equal payloads the one with the largest page_id is a response and the others
revisit it; payloads shorter than ``least_bytes`` are always responses. Which payloads repeat is
settled on digests before the pages move.

Null html is an empty payload. A null or odd URL is its own key. A null page_id comes last
among equal payloads. Of rows that repeat page and payload one is the response (the smallest
URL). An empty table gives no archive and no row. Columns beside page_id, url and html may have
any name.

A task writes under a name of its own and only names in the stored list of archives count, so
a repeated task does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import empty_if_null, reading, shared_folder, stored, table, writing

LEAST_BYTES = 0
LINES_PER_BLOCK = 256
MAGIC = b"WIDX0001"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-01T00:00:00Z"
NO_PAGE = -(2**63)

URL = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(:[0-9]*)?(.*)$"


def url_key(url: str) -> Column:
    """The URL with its host reversed, in lower case: com,example,www)/path?query."""
    text = empty_if_null(url)
    host = F.reverse(F.split(F.lower(F.regexp_extract(text, URL, 1)), r"\."))
    key = F.concat(F.array_join(host, ","), F.regexp_extract(text, URL, 2), F.lit(")"), F.regexp_extract(text, URL, 3))
    plain = F.when(F.regexp_extract(text, URL, 1) != "", key).otherwise(text)
    return F.regexp_replace(plain, r"[\x00-\x20]", "%20")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisits:
        head.append(f"WARC-Profile: {PROFILE}")
        head.append(f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def fields(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines if b":" in x)}


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def parsed(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record.

    A response's payload is measured and hashed again; a wrong digest is an error.
    """
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head.split(b"\r\n"))
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    page = page_of(warc["warc-record-id"])
    if warc["warc-type"] == "revisit":
        size = int(fields(http.split(b"\r\n"))["content-length"])
        return page, size, digest, "revisit", page_of(warc["warc-refers-to"])
    if payload_digest(payload) != digest:
        raise ValueError(f"page {page}: payload does not have its digest")
    return page, len(payload), digest, "response", None


class IndexWriter:
    """Sorted lines into compressed blocks, and the directory behind them."""

    def __init__(self, out, lines_per_block: int = LINES_PER_BLOCK):
        self.out, self.size, self.most = out, 0, lines_per_block
        self.lines: list[list] = []
        self.directory: list[list] = []

    def add(self, key: str, page: int, offset: int, length: int) -> None:
        self.lines.append([key, page, offset, length])
        if len(self.lines) == self.most:
            self._block()

    def _block(self) -> None:
        data = gzip.compress("\n".join(json.dumps(x) for x in self.lines).encode(), 6, mtime=0)
        self.directory.append([*self.lines[0][:2], self.size, len(data)])
        self.out.write(data)
        self.size += len(data)
        self.lines = []

    def close(self) -> None:
        if self.lines:
            self._block()
        data = gzip.compress(json.dumps(self.directory).encode(), 6, mtime=0)
        self.out.write(data + struct.pack("<Q", len(data)) + MAGIC)
        self.out.close()


def place(key: str, page: int) -> tuple[bytes, int]:
    """What lines are ordered by: bytes of the key as Spark orders them, then the page."""
    return key.encode(), page


class IndexReader:
    """Lookups in one index; keeps its directory and the block last read."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        tail = file.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a capture index")
        (length,) = struct.unpack("<Q", tail[:8])
        self.directory = json.loads(gzip.decompress(file.read_at(length, end - 16 - length)))
        self.firsts = [place(*x[:2]) for x in self.directory]
        self.held: tuple[int, list, list] = (-1, [], [])

    def block(self, number: int) -> tuple[list, list]:
        if self.held[0] != number:
            _, _, offset, length = self.directory[number]
            lines = [json.loads(x) for x in gzip.decompress(self.file.read_at(length, offset)).split(b"\n")]
            self.held = (number, lines, [place(*x[:2]) for x in lines])
        return self.held[1], self.held[2]

    def find(self, key: str, page: int) -> Iterator[tuple[int, int]]:
        """Offset and length of every record of the page under the key."""
        wanted = place(key, page)
        number = max(0, bisect_left(self.firsts, wanted) - 1)
        while number < len(self.firsts) and self.firsts[number] <= wanted:
            lines, places = self.block(number)
            for line in lines[bisect_left(places, wanted) : bisect_right(places, wanted)]:
                yield line[2], line[3]
            number += 1


ARCHIVES = "file_no int, archive string, index string, first_key string, first_page long, records long, bytes long"


def repeated_payloads(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """key, place, digest and the responding page of every page whose payload repeats.

    Only digests and addresses move. Largest page first, then smallest URL.
    """
    slim = pages.select("key", "place", "page_id", "url", F.sha1("html").alias("digest"), F.octet_length("html").alias("bytes"))
    rank = F.struct(F.col("page_id").isNull(), (-F.col("page_id")).alias("down"), "url", "page_id")
    winners = (
        slim.filter(F.col("bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(rank).alias("winner"))
        .filter("n > 1")
        .select("digest", F.col("winner.page_id").alias("win_page"), F.col("winner.url").alias("win_url"))
    )
    return slim.join(winners, "digest").select("key", "place", "digest", "win_page", "win_url").distinct()


def write_archives(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write archives and indexes; the stored list of them, one row per archive in key order.

    What is known of repeated payloads travels with the pages, sorted in front of the page
    that it concerns, so pages are shuffled once and joined with nothing.
    """
    folder = shared_folder(spark, "warc")
    addressed = pages.select(
        url_key("url").alias("key"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("place"),
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        empty_if_null("html").alias("html"),
    )
    notes = repeated_payloads(addressed, least_bytes).withColumn("turn", F.lit(0))
    rows = notes.unionByName(addressed.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    ordered = rows.repartitionByRange("key", "place").sortWithinPartitions("key", "place", "turn", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        name = f"{folder}/part-{number:05d}-{uuid.uuid4().hex}"
        out = index = first = at = None
        size = records = 0
        known: dict[str, tuple] = {}
        answered: set[str] = set()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "place", "turn", "page_id", "url", "html", "digest", "win_page", "win_url"))
            for key, place_, turn, page, url, html, digest, win_page, win_url in zip(*columns):
                if at != (key, place_):
                    at, known, answered = (key, place_), {}, set()
                if turn == 0:
                    known[digest] = (win_page, win_url)
                    continue
                if out is None:
                    out, index, first = writing(name + ".warc.gz"), IndexWriter(writing(name + ".index")), at
                payload = html.encode()
                own = hashlib.sha1(payload).hexdigest()
                # Of rows that repeat the responding page in full the first one responds.
                responds = own not in known or (known[own] == (page, url) and own not in answered)
                answered.add(own)
                member = record(page, url, payload, not responds, known.get(own, (None,))[0])
                out.write(member)
                index.add(key, place_, size, len(member))
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            index.close()
            row = [number, name + ".warc.gz", name + ".index", *first, records, size]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["file_no", "archive", "index", "first_key", "first_page", "records", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return stored(spark, ordered.mapInArrow(write, ARCHIVES), "archive-list")


def look_up(archives: DataFrame, captures: DataFrame) -> DataFrame:
    """The records of captures (key, place), read back through the index.

    ``place`` is the page_id, or NO_PAGE for none. The list of archives, one row per write task,
    goes to every task; captures come in key order, so neighbours use one block.
    """
    listed = [
        (place(r["first_key"], r["first_page"]), r["archive"], r["index"])
        for r in archives.orderBy("file_no").collect()
    ]
    firsts = [x[0] for x in listed]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        current, index, archive = -1, None, None
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = bisect_right(firsts, place(key, page)) - 1
                if number < 0:
                    continue
                if number != current:
                    current, archive, index = number, reading(listed[number][1]), IndexReader(reading(listed[number][2]))
                rows += [parsed(archive.read_at(length, offset)) for offset, length in index.find(key, page)]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    once = captures.select("key", "place").distinct()
    # About a task per archive: the keys are few bytes, the records behind them are not.
    ordered = once.repartitionByRange(max(1, len(listed)), "key", "place").sortWithinPartitions("key", "place")
    return ordered.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(spark, pages)
    place_of = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE))
    return look_up(archives, pages.select(url_key("url").alias("key"), place_of.alias("place")))


SQL = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS win,
         row_number() OVER (PARTITION BY hex ORDER BY page_id DESC NULLS LAST, url) AS nth FROM p)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         ((('0x' || substr(hex, CAST(1 + (5 * i) // 4 AS INT), 2))::INT >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS INT), 1)),
         lambda a, b: a || b) AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN win END AS refers_to
FROM r
"""
