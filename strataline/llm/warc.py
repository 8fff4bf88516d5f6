"""Legacy web archives to WARC: ARC files are read by their headers and lengths, and written as equivalent WARC records.

ARC 1 and ARC 2 files begin with a version block that names the fields of their record headers; a
header line has those fields, the last of them the length in bytes of what follows. Only declared
lengths say where a record ends, so payloads may hold anything, archive headers included. For each record a WARC identifier is
synthesised from the file and the offset (the same in every retry), the 14-digit date becomes an ISO one,
HTTP responses become ``response`` and others ``resource`` records, and SHA-1 digests of block and payload
are added. Of records with equal payloads, the first in a given order stays a response; others become
``revisit`` records, which hold the HTTP header and name the first one.

Archives are written by Spark's text writer, one for each task, whose commit protocol drops what a lost
executor leaves behind; each begins with a version block or a warcinfo record. They are read as text that is
cut at each CR LF CR LF, so that no reader holds more than a piece; a task puts the pieces of a file together again and
gives one record after the other. Compressed archives can't be split, so pieces come in order; those of other archives
may come from several splits, and are sorted by split first. A single record is limited to 2 GB, as any Spark value.

Null payloads are empty, null URLs ``about:blank``; white space in a URL is escaped. Null ids order last and refer to nothing; of
records with equal ids the one that stands first in the archives stays. An empty table gives archives without records. A record that
the file's end cuts short has ``truncated`` set; a header that can't be read raises an error with file and offset, or with
``on_error="report"`` ends that file with a row whose ``problem`` says so. Payloads are kept as stored (no transfer or content
decoding). Archives are one gzip member each.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.storage import deleted, shared_folder, small_or_shuffled, written
from strataline.llm.text_arrays import release

#: Where text is cut for reading; what is put back between the pieces.
CUT = b"\r\n\r\n"

# Field names of the two versions of ARC headers.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

ARC_SCHEMA = "file string, offset long, version int, url string, ip string, date string, mime string, length long, http binary, payload binary, payload_bytes long, payload_digest string, block_digest string, truncated boolean, problem string"
WARC_SCHEMA = "file string, offset long, type string, record_id string, date string, url string, refers_to string, stated_digest string, length long, http binary, payload binary, payload_bytes long, payload_digest string, block_digest string, truncated boolean, problem string"

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


class Pieces:
    """A file's bytes in order, read by lines or lengths without holding more than asked for."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.offset = pieces, b"", 0, 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = piece + CUT, 0
        return True

    def _take(self, end: int) -> bytes:
        out = self.held[self.at : end]
        self.at += len(out)
        self.offset += len(out)
        return out

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and (self.at < len(self.held) or self._more()):
            out.append(self._take(self.at + n))
            n -= len(out[-1])
        return b"".join(out)

    def line(self) -> bytes:
        """Up to and with the next line feed; empty at the end."""
        out = []
        while self.at < len(self.held) or self._more():
            end = self.held.find(b"\n", self.at)
            out.append(self._take(end + 1 if end >= 0 else len(self.held)))
            if end >= 0:
                break
        return b"".join(out)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The header of an HTTP response (with its blank line) and its body; another block is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [end for end in (block.find(x) + len(x) for x in (b"\r\n\r\n", b"\n\n") if x in block)]
    at = min(ends, default=len(block))
    return block[:at], block[at:]


def _described(block: bytes, length: int) -> dict:
    http, payload = http_parts(block)
    return {"length": length, "http": http, "payload": payload, "payload_bytes": len(payload), "payload_digest": sha1_base32(payload), "block_digest": sha1_base32(block), "truncated": len(block) < length}


def arc_records(pieces: Pieces) -> Iterator[dict]:
    """The records of an ARC file, without version blocks."""
    names: list[str] = []
    version = 0
    while line := pieces.line():
        header, start = line.rstrip(b"\r\n"), pieces.offset - len(line)
        if not header:
            continue
        about = header.startswith(b"filedesc://")  # of a version block; archives may follow each other
        fields = header.rsplit(b" ", 1 if about or not names else len(names) - 1)
        if not fields[-1].isdigit() or not (about or not names or len(fields) == len(names)):
            raise ValueError(f"no ARC header at byte {start}")
        block = pieces.read(int(fields[-1]))
        if about:
            lines = block.decode("latin-1").split("\n")
            version, names = int(lines[0].split(" ")[0]), lines[1].strip().split(" ")
            continue
        if not names:
            raise ValueError("no version block at the begin of the file")
        value = dict(zip(names, (x.decode("utf-8", "replace") for x in fields), strict=True))
        yield {"offset": start, "version": version, "url": value["URL"], "ip": value["IP-address"], "date": value["Archive-date"], "mime": value["Content-type"]} | _described(block, int(fields[-1]))


def warc_records(pieces: Pieces) -> Iterator[dict]:
    """The records of a WARC file, warcinfo too."""
    while line := pieces.line():
        start = pieces.offset - len(line)
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC header at byte {start}")
        value: dict[str, str] = {}
        name = ""
        while line := pieces.line().rstrip(b"\r\n").decode("utf-8", "replace"):
            if line[0] in " \t":  # goes on
                value[name] += " " + line.strip()
            else:
                name, _, text = line.partition(":")
                value[name := name.lower()] = text.strip()
        if not value.get("content-length", "").isdigit():
            raise ValueError(f"no Content-Length at byte {start}")
        length = int(value["content-length"])
        stated = {"type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "url": "warc-target-uri", "refers_to": "warc-refers-to"}
        yield {"offset": start, "stated_digest": value.get("warc-payload-digest", "").removeprefix("sha1:") or None} | {k: value.get(x) for k, x in stated.items()} | _described(pieces.read(length), length)


def _read(spark: SparkSession, path: str, records: Callable[[Pieces], Iterator[dict]], schema: str, with_payload: bool, on_error: str) -> DataFrame:
    kinds = [x.split(" ") for x in schema.split(", ")]
    arrow = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]) for name, kind in kinds])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for file, own in itertools.groupby(pieces(batches), lambda x: x[0]):
            try:
                for row in records(Pieces(x for _, x in own)):
                    yield row | {"file": file} | ({} if with_payload else {"payload": None})
            except ValueError as e:
                if on_error == "raise":
                    raise ValueError(f"{file}: {e}") from None
                yield {"file": file, "problem": str(e)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in found(batches):
            held.append(row)
            size += len(row.get("payload") or b"") + len(row.get("http") or b"") + 500
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
                release()
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    text = spark.read.option("lineSep", CUT.decode()).text(path)
    cut = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    if not all(f.endswith(".gz") for f in text.inputFiles()):
        cut = cut.repartition("file").sortWithinPartitions("file", "split", "place")
    return cut.select("file", "piece").mapInArrow(rows, schema)


def read_arc(spark: SparkSession, path: str, *, with_payload: bool = True, on_error: str = "raise") -> DataFrame:
    """One row for each record of the ARC files at path, in ARC_SCHEMA."""
    return _read(spark, path, arc_records, ARC_SCHEMA, with_payload, on_error)


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True, on_error: str = "raise") -> DataFrame:
    """One row for each record of the WARC files at path, in WARC_SCHEMA; payload digests are those of what is stored."""
    return _read(spark, path, warc_records, WARC_SCHEMA, with_payload, on_error)


def _write(rows: DataFrame, head: Column, path: str) -> None:
    """Rows (value), each followed by a line feed, after head in each file."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    rows.select(F.concat(F.when(first, head).otherwise(F.lit("")), F.col("value"))).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _bytes(c: Column) -> Column:
    return F.octet_length(c).cast("string")


def write_arc(captures: DataFrame, path: str, version: Column | int = 1) -> None:
    """Archives of rows (url, ip, date, mime, block binary); version: 1 or 2 for all files, or a column that is the same in a task."""
    version = version if isinstance(version, Column) else F.lit(version)
    block = F.coalesce(F.col("block").cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x20\x09-\x0D]", "%20"), "^$", "about:blank")
    fields = [url, F.coalesce("ip", F.lit("0.0.0.0")), F.coalesce("date", F.lit("19700101000000")), F.coalesce("mime", F.lit("no-type"))]
    more = [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("archive")]
    value = F.concat(F.concat_ws(" ", *fields), F.when(version == 2, F.concat(F.lit(" "), F.concat_ws(" ", *more))).otherwise(F.lit("")), F.lit(" "), _bytes(block), F.lit("\n"), block)

    def head(v: int) -> str:
        body = f"{v} 0 strataline\n{ARC_FIELDS[v]}\n"
        return " ".join(["filedesc://archive", "0.0.0.0", "19700101000000", "text/plain", *(["200", "-", "-", "0", "archive"] if v == 2 else []), str(len(body))]) + f"\n{body}\n"

    _write(captures.select(value.alias("value")), F.when(version == 2, F.lit(head(2))).otherwise(F.lit(head(1))), path)


def synthesised(records: DataFrame) -> DataFrame:
    """ARC records with what WARC needs besides: record_id, warc_date, type."""
    h = F.md5(F.concat_ws(" ", "file", F.col("offset").cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    name = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12)), F.lit(">"))
    digits = F.when(F.col("date").rlike("^[0-9]{4,14}$"), F.col("date")).otherwise(F.lit(""))
    full = F.concat(digits, F.substring(F.lit("19700101000000"), F.length(digits) + 1, F.lit(14)))
    iso = F.regexp_replace(full, "^(....)(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z")
    return records.withColumns({"record_id": name, "warc_date": iso, "type": F.when(F.octet_length("http") > 0, F.lit("response")).otherwise(F.lit("resource"))})


def revisits(records: DataFrame, order: list[str], min_bytes: int = 0) -> DataFrame:
    """(file, offset, first_id, first_url, first_date) of the responses whose payload an earlier one has.

    records: written, with record_id, warc_date and type. Responses of at least min_bytes with equal payloads are compared by
    order (nulls last), then file and offset.
    """
    some = records.filter((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes))
    key = ["payload_digest", "payload_bytes"]
    rank = [x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    first = some.groupBy(*key).agg(F.min(F.struct(*rank, "file", "offset", "record_id", "url", "warc_date")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first = written(first.select(*key, F.col("first.record_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.warc_date").alias("first_date")), "first-payloads")
    others = some.select(*key, "file", "offset", "record_id").join(small_or_shuffled(first), key).filter("record_id != first_id")
    return others.select("file", "offset", "first_id", "first_url", "first_date")


def write_warc(records: DataFrame, path: str) -> None:
    """Archives of records as synthesised() gives them, with first_id, first_url and first_date set where a record is a revisit."""
    again = F.col("first_id").isNotNull()
    http, payload = F.col("http").cast("string"), F.col("payload").cast("string")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(payload))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("type"))), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("first_id")), line("WARC-Refers-To-Target-URI", F.col("first_url")), line("WARC-Refers-To-Date", F.col("first_date")))).otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha1:"), "block_digest"))),
        F.when(F.col("truncated"), line("WARC-Truncated", F.lit("unspecified"))).otherwise(F.lit("")),
        line("Content-Type", F.when(F.octet_length("http") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))), line("Content-Length", _bytes(block)), F.lit("\r\n"),
    )
    about = "software: strataline\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    info = F.concat(F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit("warcinfo "), "record_id")), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-8$3-a$4-$5"), F.lit(f">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n"))
    # a record's two line ends after its block; the writer adds the last character
    rows = records.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"), "record_id")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    rows.select(F.concat(F.when(first, info).otherwise(F.lit("")), F.col("value"))).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, *, order: dict[str, Column] | None = None, min_bytes: int = 0) -> None:
    """Writes the ARC files at arc_path as WARC files.

    order: columns (of what read_arc gives) by which the first of equal payloads is chosen; as a rule their dates.
    """
    order = order or {"by_date": F.col("date")}
    records = written(synthesised(read_arc(spark, arc_path)).withColumns(order), "arc-records")
    again = written(revisits(records, list(order), min_bytes), "revisits")
    write_warc(records.join(small_or_shuffled(again), ["file", "offset"], "left"), warc_path)
    deleted(records, again)


def header_number(name: str) -> Column:
    """The number in a field of the stored HTTP header."""
    found = F.regexp_extract(F.col("http").cast("string"), rf"(?im)^{name}:[\x20\x09]*(-?[0-9]+)[\x20\x09]*\r?$", 1)
    return F.when(found != "", found.cast("long"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as captures: an HTTP response whose header carries the id and the length."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("long").cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), own, F.lit("Content-Length: "), _bytes(html), F.lit("\r\n\r\n"), html)
    return pages.select("url", F.lit("0.0.0.0").alias("ip"), F.lit("20000101000000").alias("date"), F.lit("text/html").alias("mime"), block.cast("binary").alias("block"))


def page_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of archived pages."""
    stored = read_warc(spark, warc_path, with_payload=False).filter("type IN ('response', 'revisit')")
    again = F.col("type") == "revisit"
    rows = stored.select(header_number("X-Page-Id").alias("page_id"), "record_id", F.col("refers_to").alias("first_id"), F.col("type").alias("record_type"), F.when(again, header_number("Content-Length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(again, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"))
    rows = written(rows, "page-records")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    firsts = rows.filter("record_type = 'response'")
    ids = firsts.select(F.col("record_id").alias("first_id"), F.col("page_id").alias("refers_to"))
    return firsts.select(*names[:-1], F.lit(None).cast("long").alias("refers_to")).unionByName(rows.filter("record_type = 'revisit'").join(small_or_shuffled(ids, rows), "first_id", "left").select(*names))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    # both versions of the legacy format, by task
    write_arc(captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")), f"{folder}/arc", F.spark_partition_id() % 2 + 1)
    convert_arc(spark, f"{folder}/arc", f"{folder}/warc", order={"page_id": header_number("X-Page-Id")})
    deleted(spark.read.text(f"{folder}/arc"))
    return page_records(spark, f"{folder}/warc")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
