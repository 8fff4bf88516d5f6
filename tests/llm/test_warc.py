"""Archives written by hand are read; archives of pages are converted and read back."""

import base64
import collections
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from strataline.llm import warc as op

from tests.oracle import rows, sql_rows

SF = "/root/testdata/sf0.001"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(version, records):
    body = f"{version} 0 Someone\n{op.ARC_FIELDS[version]}\n".encode()
    more = b" 200 - - 0 f" if version == 2 else b""
    out = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain" + more + b" %d\n" % len(body) + body
    for url, date, mime, block in records:
        out += b"\n" + b" ".join([url, b"1.2.3.4", date, mime]) + (b" 301 abc - 17 f.arc" if version == 2 else b"") + b" %d\n" % len(block) + block
    return out + b"\n"


def warc_file(records):
    return b"".join(b"WARC/1.0\r\n" + b"".join(b"%s: %s\r\n" % x for x in head) + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n" for head, block in records)


def odd_payloads(seed, n):
    r = random.Random(seed)
    parts = [b"\r\n\r\n", b"\r", b"\n", b"\r\n", b"\r\r\n\r\n", b"\0\xff\xfe", "é😀".encode(), b"WARC/1.1\r\nContent-Length: 5\r\n\r\n", b"http://a 1.2.3.4 19990101000000 text/html 12\n", b"filedesc://y 0.0.0.0 1 text/plain 3\n", b"x" * 700, b" "]
    return [b"".join(r.choices(parts, k=r.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_legacy_archives(spark, tmp_path, monkeypatch, packed):
    payloads = odd_payloads(1, 120)
    blocks = [b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + p if i % 3 else p or b"dns" for i, p in enumerate(payloads)]
    records = [(b"http://h/%d a" % i, b"%d" % (19960101000000 + i), b"text/html", b) for i, b in enumerate(blocks)]
    for k in range(4):
        data = arc_file(1 + k % 2, records[30 * k : 30 * k + 30])
        # a second archive behind the first, of the other version
        data += arc_file(2 - k % 2, records[30 * k : 30 * k + 3])
        (tmp_path / (f"{k}.arc.gz" if packed else f"{k}.arc")).write_bytes(gzip.compress(data) if packed else data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = op.read_arc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = collections.Counter()
    for k in range(4):
        for j, (url, date, mime, block) in enumerate(records[30 * k : 30 * k + 30] + records[30 * k : 30 * k + 3]):
            http, payload = op.http_parts(block)
            want[1 + (k + (j >= 30)) % 2, url.decode(), date.decode(), http, payload, digest(payload), digest(block), False] += 1
    assert collections.Counter((r["version"], r["url"], r["date"], bytes(r["http"]), bytes(r["payload"]), r["payload_digest"], r["block_digest"], r["truncated"]) for r in got) == want
    assert len({(r["file"], r["offset"]) for r in got}) == len(got)


def test_conversion_keeps_every_byte(spark, tmp_path):
    payloads = odd_payloads(2, 60) * 2 + [b""] * 5
    blocks = [b"HTTP/1.0 200 OK\r\n\r\n" + p for p in payloads] + [b"93.184.216.34"] * 2
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/a.arc").write_bytes(arc_file(2, [(b"http://h/%d" % i if i < 125 else b"dns:h", b"%d" % (20000101000000 + i) if i != 3 else b"2000", b"text/x", b) for i, b in enumerate(blocks)]))
    op.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), min_bytes=1)
    stored = [r for r in op.read_warc(spark, str(tmp_path / "warc")).collect() if r["type"] != "warcinfo"]
    by_id = {r["record_id"]: r for r in stored}
    assert len(by_id) == len(stored) == len(blocks)
    assert collections.Counter(r["type"] for r in stored)["resource"] == 2
    seen = collections.Counter()
    for r in stored:
        first = by_id[r["refers_to"]] if r["type"] == "revisit" else r
        assert first["type"] != "revisit" and first["payload_digest"] == r["stated_digest"] == first["stated_digest"]
        assert r["type"] != "revisit" or (first["date"] < r["date"] and not r["payload"] and bytes(first["payload"]))
        seen[bytes(first["payload"])] += 1
    assert seen == collections.Counter(op.http_parts(b)[1] for b in blocks)
    assert {r["date"] for r in stored if r["url"] in ("http://h/3", "http://h/9")} == {"2000-01-01T00:00:00Z", "2000-01-01T00:00:09Z"}
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/warc/*.gz"))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")


def test_reading_other_warc_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nbody\r\n\r\nWARC/1.0\r\n"
    head = [(b"warc-type", b"response"), (b"WARC-Record-Id", b"<urn:uuid:1>"), (b"WARC-Target-URI", b"http://a/\r\n  b")]
    (tmp_path / "a.warc").write_bytes(warc_file([([(b"WARC-Type", b"warcinfo")], b"software: y\r\n"), (head, block), (head, b"")]))
    (tmp_path / "b.warc").write_bytes(warc_file([(head, block)])[:-20])
    (tmp_path / "c.warc").write_bytes(warc_file([(head, block)]) + b"garbage\r\n")
    with pytest.raises(Exception, match="no WARC header at byte"):
        op.read_warc(spark, f"{tmp_path}/c.warc").collect()
    got = op.read_warc(spark, str(tmp_path), on_error="report").collect()
    one = [r for r in got if r["file"].endswith("a.warc")]
    assert [(r["type"], bytes(r["payload"]), r["length"], r["truncated"]) for r in sorted(one, key=lambda r: r["offset"])] == [("warcinfo", b"software: y\r\n", 13, False), ("response", b"body\r\n\r\nWARC/1.0\r\n", len(block), False), ("response", b"", 0, False)]
    assert one[1]["url"] == "http://a/ b"
    assert [r["truncated"] for r in got if r["file"].endswith("b.warc")] == [True]
    assert sorted(str(r["problem"]) for r in got if r["file"].endswith("c.warc"))[1].startswith("no WARC header")
    (tmp_path / "d.arc").write_bytes(b"http://a 1.2.3.4 19990101000000 text/html 1\nx\n")
    with pytest.raises(Exception, match="no version block"):
        op.read_arc(spark, f"{tmp_path}/d.arc").collect()


def test_nulls_copies_and_extra_columns(spark, tmp_path):
    pages = [(1, "http://a b\n", "<p>é😀", 1), (None, None, "<p>é😀", 1), (0, "", "<p>é😀", 1), (5, "u", None, 1), (4, "u", "", 1), (7, "u", "\r\n\r\nX-Page-Id: 99\r\n", 1), (7, "u", "\r\n\r\nX-Page-Id: 99\r\n", 1), (-3, "u", "long" * 500_000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    op.write_arc(op.captures_of(df), f"{tmp_path}/arc", F.spark_partition_id() % 2 + 1)
    op.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", order={"page_id": op.header_number("X-Page-Id")})
    got = collections.Counter(tuple(r) for r in op.page_records(spark, f"{tmp_path}/warc").collect())
    out = lambda i, html, kind, first=None: (i, len(html.encode()), digest(html.encode()), kind, first)
    same = "<p>é😀"
    assert got == collections.Counter([out(0, same, "response"), out(1, same, "revisit", 0), out(None, same, "revisit", 0), out(4, "", "response"), out(5, "", "revisit", 4), out(7, pages[5][2], "response"), out(7, pages[5][2], "revisit", 7), out(-3, pages[7][2], "response")])


def test_no_pages(spark, tmp_path):
    op.write_arc(op.captures_of(spark.createDataFrame([], "page_id long, url string, html string")), f"{tmp_path}/arc")
    op.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert op.page_records(spark, f"{tmp_path}/warc").count() == 0


def test_query_agrees_with_sql(spark):
    assert rows(op.op12_warc(spark, SF).toPandas()) == sql_rows(SF, op.ORACLE)
