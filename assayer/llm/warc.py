"""Web archives: records written from pages, read back, and put together as one nested row per capture.

Records follow WARC/1.1. A file is a run of records that each end in an empty line, written by Spark's text writer
with that ending as its line separator (so the bytes are a plain archive, here gzipped as a whole); a lost task is
written again by the usual commit protocol.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.arrowio import SLICE_BYTES, bound_batches, rows
from assayer.llm.shared import release

END = "\r\n\r\n"
ANCHORS = ("response", "revisit", "resource")
# fixed values: the two alphabets of base 32 and the profile of a revisit
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = [("record_id", "string"), ("record_type", "string"), ("concurrent_to", "array<string>"),
          ("refers_to", "string"), ("target_uri", "string"), ("declared_digest", "string"), ("block", "binary"),
          ("payload", "binary")]
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)
ARROW = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[t])
                   for n, t in FIELDS])


def payload_digest(payload: Column) -> Column:
    """Base 32 of the SHA-1 of a binary column."""
    hexed = F.upper(F.sha1(payload))
    groups = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def _urn(*parts: Column) -> Column:
    hexed = F.md5(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])).cast("binary"))
    return F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: str | Column, record_id: Column, block: Column, *headers: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id), *headers,
        F.concat(F.lit("Content-Length: "), F.octet_length(block)), F.lit(""), block)


def page_records(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """Three records per page in a column ``value``: its response or revisit, its request and its metadata.

    Of pages with equal payloads of at least ``min_bytes`` bytes that with the smallest page id (then url) is the
    response and the others revisit it; null page ids sort last. Null html is an empty payload, a null url an empty
    one. Pages that repeat id, url and html make repeated records. Equal payloads are found by SHA-1, a second
    fingerprint and length, combined before the shuffle.
    """
    page = pages.select(F.col(page_col).cast("string").alias("page"), F.col(page_col).alias("order"),
                        F.coalesce(F.translate(F.col(url_col), "\r\n", ""), F.lit("")).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    raw = F.col("html").cast("binary")
    page = page.select("*", payload_digest(raw).alias("digest"), F.octet_length("html").alias("bytes"),
                       F.xxhash64("html").alias("check"))
    key = ["digest", "bytes", "check"]
    first = (page.filter(F.col("bytes") >= min_bytes).groupBy(*key)
             .agg(F.min(F.struct(F.col("order").isNull().alias("none"), "order", "page", "url")).alias("first")))
    page = page.join(first, key, "left")
    own = _urn(F.lit("response"), F.col("page"), F.col("url"), F.col("digest"))
    source = _urn(F.lit("response"), F.col("first.page"), F.col("first.url"), F.col("digest"))
    page = page.select("*", own.alias("id"), source.alias("source")).withColumn(
        "again", F.col("first").isNotNull() & (F.col("id") != F.col("source")))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"),
                    F.lit("\r\n\r\n"))
    main = _record(
        F.when(F.col("again"), "revisit").otherwise("response"), F.col("id"),
        F.when(F.col("again"), head).otherwise(F.concat(head, F.col("html"))), uri,
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), F.col("source"))),
        F.when(F.col("again"), F.lit(f"WARC-Profile: {PROFILE}")))
    target = F.concat(F.lit("WARC-Concurrent-To: "), F.col("id"))
    path = F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*", "")
    request = _record(
        "request", _urn(F.lit("request"), F.col("id")),
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "),
                 F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit("\r\n\r\n")),
        uri, F.lit("Content-Type: application/http;msgtype=request"), target)
    metadata = _record(
        "metadata", _urn(F.lit("metadata"), F.col("id")),
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page"), F.lit("\r\n")), F.lit("")),
        uri, F.lit("Content-Type: application/warc-fields"), target)
    return page.select(F.explode(F.array(main, request, metadata)).alias("value"))


def write_archives(records: DataFrame, path: str, records_per_file: int = 12288) -> None:
    """Archives of bounded length under ``path``; the shuffle files of the writing job are freed.

    Packed at gzip's fastest level: the usual one takes several times the CPU time for archives that are a little smaller.
    """
    (records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", records_per_file).text(path))
    release(records)


def _unpacked(content: bytes):
    """Chunks of the unpacked bytes; several gzip members may follow each other."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        inflate = zlib.decompressobj(31)
        while content and not inflate.eof:
            yield inflate.decompress(content, 1 << 20)
            content = inflate.unconsumed_tail or inflate.unused_data
        if not inflate.eof:
            yield inflate.flush()
            return


class _Stream:
    """Reads by delimiter and by length over chunks, holding little more than one record."""

    def __init__(self, chunks):
        self.chunks, self.held, self.at = chunks, bytearray(), 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        if self.at:
            del self.held[:self.at]
            self.at = 0
        self.held += chunk
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = self.at
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(self.at, len(self.held) - len(mark)) - self.at
            if not self._more():
                return None
            seen += self.at
        out = bytes(self.held[self.at:i])
        self.at = i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        out = bytes(self.held[self.at:self.at + n])
        self.at += len(out)
        return out


def parse_archive(content: bytes):
    """Records of one archive as tuples of ``FIELDS``; lengths come from Content-Length, so blocks may hold any bytes.

    A file that ends inside a record gives the records before it.
    """
    stream = _Stream(iter(_unpacked(content)))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            continue
        named: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            named.setdefault(name.strip().lower(), []).append(value.strip())
        one = {k: v[0] for k, v in named.items()}
        length = int(one.get("content-length", "0"))
        block = stream.take(length)
        if len(block) < length:
            return
        payload = block
        if one.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        yield (one.get("warc-record-id"), one.get("warc-type"), named.get("warc-concurrent-to", []),
               one.get("warc-refers-to"), one.get("warc-target-uri"), one.get("warc-payload-digest"), block, payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path`` (``FIELDS``), files in parallel, a file in bounded steps."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for record in parse_archive(content.as_py() or b""):
                    held.append(record)
                    size += len(record[6])
                    if size > SLICE_BYTES:
                        yield rows(ARROW, *map(list, zip(*held)))
                        held, size = [], 0
        if held:
            yield rows(ARROW, *map(list, zip(*held)))

    return files.mapInArrow(run, SCHEMA)


def assemble(records: DataFrame, part_size: int = 1000) -> DataFrame:
    """One nested row per capture: the response (or revisit, resource) with its requests and metadata records.

    A record belongs to the capture whose main record its concurrent-to identifiers name, directly, through one
    other record, or because the main record names it. Lists are sorted by record id and hold each record once; the
    companions of a capture with more than ``part_size`` of them are dealt over further rows (``part`` from 1 on, the
    main record repeated), so no list grows without bound. Main records that repeat give repeated rows; companions
    whose capture is absent are left out; records without an id cannot be named and join nothing.
    """
    main = records.filter(F.col("record_type").isin(*ANCHORS))
    other = records.filter(~F.col("record_type").isin(*ANCHORS) & F.col("record_id").isNotNull())
    named = other.select("record_id", F.explode("concurrent_to").alias("target")).distinct()
    step = named.select(F.col("record_id").alias("target"), F.col("target").alias("next"))
    direct = named.join(step, "target", "left").select("record_id", F.explode(F.array_distinct(F.array_compact(
        F.array("target", "next")))).alias("capture"))
    back = main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    links = direct.union(back).distinct()
    sizes = links.groupBy("capture").agg(F.ceil(F.count(F.lit(1)) / part_size).alias("parts"))
    links = links.join(sizes, "capture").select(
        "record_id", "capture", F.pmod(F.xxhash64("record_id"), F.col("parts")).alias("part"))
    body = other.select("record_id", "record_type", "target_uri", "block").dropDuplicates(["record_id"])
    item = F.struct("record_id", "target_uri", "block")
    lists = links.join(body, "record_id").groupBy("capture", "part").agg(
        F.sort_array(F.collect_list(F.when(F.col("record_type") == "request", item))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("record_type") != "request", item))).alias("metadata"))
    empty = F.array().cast("array<struct<record_id:string,target_uri:string,block:binary>>")
    return main.join(lists, main.record_id == lists.capture, "left").select(
        main.record_id.alias("capture_id"), F.coalesce("part", F.lit(0)).cast("long").alias("part"), "record_type",
        "target_uri", "refers_to", "declared_digest", "payload", F.coalesce("requests", empty).alias("requests"),
        F.coalesce("metadata", empty).alias("metadata"))


def warc_field(block: Column, name: str) -> Column:
    """Value of a field in an application/warc-fields block, null if absent."""
    found = F.regexp_extract(block.cast("string"), f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(found != "", found)
