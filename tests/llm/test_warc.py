from __future__ import annotations

import gzip

from ledgerline.llm import warc
from ledgerline.llm.common import reading

SCHEMA = "page_id long, url string, html string, key string, digest string, place string, revisits string, n string"


def page(page_id, url, html):
    return (page_id, url, html, "k", "d", "p", "r", "n")


PAGES = [
    page(1, "http://www.Example.com:8080/a?b=c", "<p>one</p>\r\n\r\nWARC/1.1\r\n"),
    page(2, "http://www.example.com/a", "<p>same</p>"),
    page(5, "https://example.org", "<p>same</p>"),
    page(3, "http://b.example.org/x y\nz", "<p>same</p>"),
    page(3, "http://b.example.org/x y\nz", "<p>same</p>"),
    page(4, None, None),
    page(6, "not a url", ""),
    page(None, "http://é.example/ü", "<p>é</p>"),
    page(7, "http://é.example/ü", "<p>é</p>"),
    page(8, "http://long.example/", "é" * 300_000),
    page(9, "http://twice.example/", "<p>twice</p>"),
    page(9, "http://twice.example/", "<p>twice</p>"),
]


def results(spark, pages, least_bytes=0):
    archives = warc.write_archives(spark, pages, least_bytes)
    place = warc.F.coalesce("page_id", warc.F.lit(warc.NO_PAGE)).alias("place")
    found = warc.look_up(archives, pages.select(warc.url_key("url").alias("key"), place))
    return archives, [tuple(r) for r in found.collect()]


def test_records_come_back(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    _, got = results(spark, pages)
    assert len(got) == len(PAGES)
    texts = {p[0]: p[2] or "" for p in PAGES}
    for page_id, size, digest, _, _ in got:
        assert size == len(texts[page_id].encode()) and digest == warc.payload_digest(texts[page_id].encode())
    kinds = sorted((str(r[0]), r[3], r[4]) for r in got)
    assert kinds == sorted(
        [
            ("1", "response", None), ("2", "revisit", 5), ("5", "response", None), ("3", "revisit", 5), ("3", "revisit", 5),
            ("4", "revisit", 6), ("6", "response", None), ("None", "revisit", 7), ("7", "response", None),
            ("8", "response", None), ("9", "response", None), ("9", "revisit", 9),
        ]
    )


def test_short_payloads_are_responses(spark):
    _, got = results(spark, spark.createDataFrame(PAGES, SCHEMA), least_bytes=12)
    assert {r[3] for r in got if r[0] in (2, 3, 4, 5, 6)} == {"response"}
    assert sorted(r[3] for r in got if r[0] == 9) == ["response", "revisit"]


def test_archives_are_gzip_members_in_key_order(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    archives, _ = results(spark, pages)
    data = b""
    for r in archives.orderBy("file_no").collect():
        with reading(r["archive"]) as file:
            data += gzip.decompress(file.read())
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)
    uris = [x.split(b"\r\n")[0] for x in data.split(b"WARC-Target-URI: ")[1:]]
    assert uris.index(b"http://www.example.com/a") < uris.index(b"https://example.org")


def test_keys_reverse_the_host(spark):
    rows = spark.createDataFrame(PAGES, SCHEMA).select("url", warc.url_key("url").alias("key")).collect()
    keys = {r["url"]: r["key"] for r in rows}
    assert keys["http://www.Example.com:8080/a?b=c"] == "com,example,www:8080)/a?b=c"
    assert keys["https://example.org"] == "org,example)"
    assert keys["not a url"] == "not%20a%20url" and keys[None] == ""


def test_lookup_reads_one_block(tmp_path):
    from ledgerline.llm.common import writing

    address = f"file://{tmp_path}/one.index"
    writer = warc.IndexWriter(writing(address), lines_per_block=10)
    for i in range(1000):
        writer.add(f"com,example,h{i // 3:05d})/", i, i * 100, 100)
    writer.close()

    class Counted:
        def __init__(self, file):
            self.file, self.reads = file, []

        def size(self):
            return self.file.size()

        def read_at(self, length, offset):
            self.reads.append(length)
            return self.file.read_at(length, offset)

    file = Counted(reading(address))
    index = warc.IndexReader(file)
    opened = len(file.reads)
    assert list(index.find("com,example,h00123)/", 370)) == [(37000, 100)]
    assert len(file.reads) - opened <= 2
    assert list(index.find("com,example,h00123)/", 999)) == [] and list(index.find("zz", 1)) == []
    assert all(list(index.find(f"com,example,h{i // 3:05d})/", i)) == [(i * 100, 100)] for i in range(0, 1000, 37))


def test_empty_table(spark):
    archives, got = results(spark, spark.createDataFrame([], SCHEMA))
    assert archives.count() == 0 and got == []
