"""WARC archives: captures written as request, response or revisit, and metadata records; archives read and put together again."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismlake.llm._shared import finished, materialize, scratch, utf8_rows

EOL = "\r\n"
#: Records of one archive file at most; a compressed file is read by one task.
FILE_RECORDS = 150_000
#: A key that more than this share of all rows has goes by broadcast; there can't be more such keys than its inverse.
HOT = 0.001

_FIELD = "name string, value string"
_RECORD = f"type string, record_id string, concurrent_to array<string>, refers_to string, uri string, date string, payload_digest string, http_head string, http_length long, fields array<struct<{_FIELD}>>, payload_bytes long, digest string, whole boolean, payload binary"
_TRANSACTION = ("response", "revisit", "resource", "conversion")


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits at a time are four digits of base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def joined(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left with right's columns where key is equal; right has a row for each of its keys, with n, the rows of left that have it.

    Keys of more than a thousandth of all rows of left, of which there are fewer than a thousand, are broadcast, so their
    rows stay where they are; the others meet in a shuffle that no key dominates.
    """
    hot = F.col("n") > total * HOT
    often = F.broadcast(right.where(hot).drop("n"))
    return left.join(often, key).unionByName(left.join(often.select(key), key, "left_anti").join(right.where(~hot).drop("n"), key, "left"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str | Column, block: Column, **headers: Column) -> Column:
    """A record without the two line ends after its block; headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [F.concat(F.lit(name.replace("_", "-") + ": "), value) for name, value in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL), block)


def records(pages: DataFrame, least: int = 0, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """(record): three records for each page (page_id, url, html): request, response or revisit, metadata.

    Of pages whose payloads, of `least` bytes or more, are equal, that with the smallest page_id is a response and the others
    revisit it. Requests and metadata name the response as concurrent; metadata holds the page_id. Null payloads are
    empty; a null page_id comes after all others and is left out of the metadata; line ends in a URL are escaped, a null
    one is left out. Of rows equal in page_id and payload one is the first, the others revisit it.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"]).withColumn("html", text)
    rows = materialize(rows.withColumns({"uid": F.monotonically_increasing_id(), "bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))}), "captures")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uid")
    first = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min(order)["uid"].alias("first"), F.count("*").alias("n"))
    repeated = first.where("n > 1").select("digest", "first", F.col("bytes").alias("_bytes"), "n")
    own = joined(rows, repeated, "digest", rows.count()).withColumn("first", F.when((F.col("first") != F.col("uid")) & (F.col("bytes") == F.col("_bytes")), F.col("first")))
    name = lambda kind, uid: _uuid(F.lit(kind), F.col(uid).cast("string"))
    again = F.col("first").isNotNull()
    uri, line = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(EOL)
    host, path = F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract(uri, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    common = {"WARC_Target_URI": uri, "WARC_Date": F.lit(date)}
    request = _record("request", F.concat(F.lit("GET "), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), F.coalesce(path, F.lit("")))), F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(host, F.lit("")), line, line), WARC_Record_ID=name("request", "uid"), WARC_Concurrent_To=name("response", "uid"), **common, Content_Type=F.lit("application/http; msgtype=request"))
    response = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.when(again, http).otherwise(F.concat(http, F.col("html"))),
        WARC_Record_ID=name("response", "uid"),
        WARC_Refers_To=F.when(again, name("response", "first")),
        WARC_Profile=F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")),
        **common,
        Content_Type=F.lit("application/http; msgtype=response"),
    )
    metadata = _record("metadata", F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), line), F.lit("")), WARC_Record_ID=name("metadata", "uid"), WARC_Concurrent_To=name("response", "uid"), **common, Content_Type=F.lit("application/warc-fields"))
    return own.select(F.explode(F.array(request, response, metadata)).alias("record"))


def write(pages: DataFrame, path: str, least: int = 0, date: str = "2025-01-01T00:00:00Z") -> None:
    """Archives of pages below a folder, compressed, at most FILE_RECORDS records in a file. See `records` for what is written.

    A record is a line of Spark's text writer that ends in two line ends, so it needs nothing but the file system that
    Spark writes to, and files appear only once their task is done.
    """
    records(pages, least, date).write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_HEADER = re.compile(rb"([^\s:]+):[ \t]*(.*?)[ \t]*\Z", re.DOTALL)


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Header lines by lower-case name; a line that begins with a blank goes on from the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        m = _HEADER.match(line)
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}")
        elif m:
            out.append((m[1].decode("latin-1").lower(), m[2].decode("utf-8", "replace")))
    return out


def _parsed(lines: list[bytes], block: bytes, whole: bool) -> dict:
    """A record by its header lines and block."""
    head = _fields(lines)
    one = dict(reversed(head))
    kind, content = one.get("warc-type", "").lower(), one.get("content-type", "").lower()
    http, payload, fields = None, block, []
    if content.startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = dict(_fields(http.split(b"\r\n")[1:])).get("content-length", "")
    elif content.startswith("application/warc-fields"):
        fields = [{"name": n, "value": v} for n, v in _fields(block.split(b"\r\n"))]
    return {
        "type": kind, "record_id": one.get("warc-record-id"), "concurrent_to": [v for n, v in head if n == "warc-concurrent-to"], "refers_to": one.get("warc-refers-to"),
        "uri": one.get("warc-target-uri"), "date": one.get("warc-date"), "payload_digest": one.get("warc-payload-digest", "").rpartition(":")[2].upper() or None,
        "http_head": None if http is None else http.decode("utf-8", "replace"), "http_length": int(length) if http is not None and re.fullmatch("[0-9]{1,18}", length) else None,
        "fields": fields, "payload_bytes": len(payload), "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "whole": whole, "payload": payload,
    }


class _Reader:
    """Records from the lines of archives, which come in order without their line ends."""

    def __init__(self):
        self.head: list[bytes] | None = None
        self.block: list[bytes] | None = None
        self.size = self.length = 0

    def ended(self) -> Iterator[dict]:
        """The file ends: what is open is a record that isn't whole."""
        if self.head:
            yield _parsed(self.head, b"\r\n".join(self.block or [])[: self.length], False)
        self.head = self.block = None

    def line(self, line: bytes) -> Iterator[dict]:
        if self.head is None:
            if line[:5] == b"WARC/":
                self.head, self.block = [line], None
        elif self.block is None:
            if line:
                self.head.append(line)
                return
            length = dict(_fields(self.head[1:])).get("content-length", "")
            self.block, self.size, self.length = [], -2, int(length) if re.fullmatch("[0-9]{1,18}", length) else 0
        else:
            self.block.append(line)
            self.size += len(line) + 2
            if self.size >= self.length:
                yield _parsed(self.head, b"\r\n".join(self.block)[: self.length], self.size == self.length)
                self.head = self.block = None


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the compressed archives (*.gz) below a path, one row each; without `payload` only its size and digest.

    A file is read by one task as lines between CR LF, and blocks are put together by their Content-Length, whatever they
    hold, so a task holds one record and one batch of lines. A record that ends before its length, or doesn't end with it, has `whole` false; what
    isn't a record is passed over. Header names are lower-cased; of repeated ones the first counts, but for WARC-Concurrent-To.
    """
    schema = _RECORD if payload else _RECORD.rpartition(",")[0]
    names = [c.strip().split(" ")[0] for c in re.sub("<.*?>+", "", schema).split(",")]
    field = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    types = {"concurrent_to": pa.list_(pa.string()), "http_length": pa.int64(), "payload_bytes": pa.int64(), "fields": field, "whole": pa.bool_(), "payload": pa.binary()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, found, held = _Reader(), None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], types.get(c, pa.string())) for c in names], names=names)

        for b in batches:
            for file, line in zip(b.column("file").to_pylist(), utf8_rows(b.column("value")), strict=True):
                if file != at:
                    found += reader.ended()
                    at = file
                for r in reader.line(line):
                    found.append(r)
                    held += r["payload_bytes"] if payload else 500
                if held > 1 << 23:
                    yield out()
                    found, held = [], 0
        found += reader.ended()
        if found:
            yield out()

    lines = spark.read.option("lineSep", EOL).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").text(path)
    return lines.select("value", F.xxhash64(F.input_file_name()).alias("file")).mapInArrow(parse, schema)


def captures(found: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, response, requests, metadata, of which the last three are nested records.

    A response, revisit, resource or conversion is a capture. Requests and metadata belong to the one that they name as concurrent or that names them,
    also by way of each other, in as many rounds as such a chain is long; of several the least record_id counts. A record without a
    capture has a row of its own with null response. Records that are given twice are in a capture's lists once; those without type or record_id are left out.
    """
    known = found.where("record_id IS NOT NULL AND type <> '' AND type <> 'warcinfo'")
    main = F.col("type").isin(*_TRANSACTION)
    link = known.select("record_id", "type", F.explode("concurrent_to").alias("other"))
    pairs = link.where(~main).select("record_id", "other").union(link.where(main).select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    pairs = materialize(pairs, "links")
    near = known.where(main).select(F.col("record_id").alias("other"), F.col("record_id").alias("capture_id"))
    placed = None
    while True:
        new = materialize(pairs.join(near.distinct(), "other").groupBy("record_id").agg(F.min("capture_id").alias("capture_id")), "placed")
        placed = new if placed is None else placed.union(new)
        pairs = pairs.join(placed.select("record_id"), "record_id", "left_anti")
        if not new.take(1) or not pairs.take(1):
            break
        near = new.withColumnRenamed("record_id", "other")
    record = F.struct(*[c for c in found.columns])
    side = known.where(~main).join(placed, "record_id", "left").select(F.coalesce("capture_id", "record_id").alias("capture_id"), (F.col("type") == "request").alias("asks"), record.alias("r"))
    sides = side.groupBy("capture_id").agg(F.sort_array(F.collect_set(F.when(F.col("asks"), F.col("r")))).alias("requests"), F.sort_array(F.collect_set(F.when(~F.col("asks"), F.col("r")))).alias("metadata"))
    mains = known.where(main).select(F.col("record_id").alias("capture_id"), record.alias("response"))
    return mains.join(sides, "capture_id", "full_outer").select("capture_id", "response", *[F.coalesce(c, F.array()).alias(c) for c in ("requests", "metadata")])


def with_originals(rows: DataFrame) -> DataFrame:
    """Rows (record_id, refers_to, page_id, payload_bytes) with original_id and original_bytes of what each refers to."""
    rows = materialize(rows, "referring")
    n = rows.where("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count("*").alias("n"))
    right = rows.where("refers_to IS NULL").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original_id"), F.col("payload_bytes").alias("original_bytes")).join(n, "refers_to").dropDuplicates(["refers_to"])
    return joined(rows, right, "refers_to", rows.count())


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures in archives that `write` made."""
    r, ids = F.col("response"), F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda f: f["name"] == "page_id")
    rows = captures(found).where("response IS NOT NULL").select(F.get(ids, F.lit(0))["value"].cast("long").alias("page_id"), r["record_id"].alias("record_id"), r["refers_to"].alias("refers_to"), r["type"].alias("record_type"), r["payload_bytes"].alias("payload_bytes"), r["http_length"].alias("http_length"), r["digest"].alias("digest"), r["payload_digest"].alias("payload_digest"))
    again = F.col("record_type") == "revisit"
    size = F.when(again, F.coalesce("original_bytes", "http_length")).otherwise(F.col("payload_bytes"))
    return with_originals(rows).select("page_id", size.alias("payload_bytes"), F.when(again, F.col("payload_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", F.col("original_id").alias("refers_to"))


def op12_warc_captures(pages: DataFrame) -> DataFrame:
    """Contract of op12: pages written to archives, read back, and their records put together by concurrent-to. See `records` for odd rows."""
    spark = pages.sparkSession

    def run() -> DataFrame:
        path = scratch(spark, "warc")
        write(pages, path)
        return pages_of(materialize(read(spark, path, payload=False), "records"))

    return finished(spark, "op12", run)
