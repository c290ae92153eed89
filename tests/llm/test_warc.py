import base64
import hashlib

import duckdb

from lodestone.llm import common, warc

from .conftest import collect

SCHEMA = "page_id long, url string, html string, digest string, file string"
KEYS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(rows):
    newest = {}
    for page, _, html in rows:
        if page is not None:
            newest[html or ""] = max(newest.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        top = newest.get(html or "")
        revisit = top is not None and page != top
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def run(spark, table, rows):
    out = warc.query(spark, table("pages", [(*r, "d", "f") for r in rows], SCHEMA))
    return sorted((tuple(r[k] for k in KEYS) for r in collect(out)), key=str)


def test_copies_nulls_and_ties(spark, table):
    rows = [(1, "http://a.b.c/x", "p"), (2, "http://b.c/", "p"), (3, None, None), (4, "", ""), (5, "not a url \r\n", "é" * 5000), (6, "http://[bad", "q\r\n\r\nq"), (None, "http://a/", "n"), (None, "http://b/", "p"), (7, "http://a/", "r"), (7, "http://a/", "r"), (8, "http://a/", "r")]
    assert run(spark, table, rows) == brute(rows)


def test_many_rows_over_several_blocks(spark, table):
    rows = [(i, f"http://h{i % 7}.example/{i % 50}", f"body {i % 90}" if i % 3 else None) for i in range(1500)]
    assert run(spark, table, rows) == brute(rows)


def test_empty_table(spark, table):
    assert run(spark, table, []) == []


def test_equals_sql_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    got = sorted((tuple(r[k] for k in KEYS) for r in collect(warc.query(spark, d))), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(KEYS)} FROM ({warc.ORACLE})").fetchall(), key=str)
    assert got == want


def test_index_finds_single_captures_and_reads_their_payload(spark, table, tmp_path):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"body {i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.new_dir(spark, "test-warc")
    captures = common.materialise(warc.write_archives(pages, folder), "test-captures")
    index = common.materialise(warc.write_index(captures, folder, 3), "test-index")
    reader = warc.CaptureIndex([tuple(r) for r in index.select("key", "page_id", "file", "offset", "length").collect()])
    for page in (0, 299, 599):
        ((file, offset, length),) = reader.find(warc.surt(rows[page][1]), page)
        got = warc.parse(common.Ranges().read(file, offset, length))
        assert (got["page_id"], got["payload"].decode(), got["url"]) == rows[page][:1] + (rows[page][2], rows[page][1])
    assert reader.find(warc.surt("http://nowhere.example/"), 1) == []


def test_keys():
    assert warc.surt("http://www.Example.org:80/a?b=1") == "org,example:80)/a?b=1"
    assert warc.surt(None) == ")/"
