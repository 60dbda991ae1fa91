"""WARC archives: writing with revisit records, reading, and transaction assembly.

Each capture is a request, a response (or revisit) and a metadata record; the first and the last
name the second in WARC-Concurrent-To. Records are built as SQL strings and written by Spark's text
writer with the record terminator as line separator, so archives go to any store that Spark
reaches. They are gzipped as a whole. The reader streams a file's records; assembly joins the three
kinds through their identifiers into one nested row per capture. A revisit's metadata names the page
that it repeats, so nothing has to be joined on the record it refers to. Pages are read twice, for digests
and for writing, so they must be a table that gives its rows in one order.

Defined results: null html is an empty payload; a null page_id stays null and ranks below all others, a
null url has no target; repeated rows have a record each; of equal payloads all rows with the largest
page_id are responses; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm.skew import hot_keys, join_hot
from helixspark.llm.text import named, utf8
from helixspark.llm.url_filter import url_parts
from helixspark.session import cut, discard, scratch, ship, table

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures in one archive file at most, and bytes of payload at the mean size of the pages.
PER_FILE, FILE_BYTES = 20_000, 1 << 26
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 0
#: Winners of repeated payloads are broadcast up to so many rows.
MAX_BROADCAST = 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long, refers_page long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from the hex digits five by five."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(role: str, page_id: Column, row: Column, digest: Column) -> Column:
    """A name of its own for each record: ``row`` is the number of the page's row."""
    h = F.md5(F.concat_ws("|", F.lit(role), F.coalesce(page_id.cast("string"), F.lit("null")), row.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, record_id: Column, mime: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """One record without its terminator; headers with null values are left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: {mime}")]
    lines += [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Writes a WARC transaction for every page under ``path``. Pages don't move but beside too many repeated payloads."""
    rows = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).alias("url"), utf8(named(html_col)).alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    seen = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("page_id", "row")).alias("winner"), F.max("bytes").alias("bytes")))
    n, size = seen.agg(F.sum("k"), F.sum(F.col("k") * F.col("bytes"))).first()
    per_file = max(1, min(PER_FILE, FILE_BYTES * (n or 1) // max(1, size or 1)))
    repeated = cut(seen.where((F.col("k") > 1) & (F.col("bytes") >= least)).select("digest", "winner"))
    if repeated.count() <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        rows = join_hot(rows, repeated, ["digest"], "left", hot_keys(seen, ["digest"]))
    first = F.col("winner.page_id")
    revisit = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    main, target = _record_id("response", F.col("page_id"), F.col("row"), F.col("digest")), F.regexp_replace("url", r"[\r\n]", "")
    host, http_path = url_parts(target)
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    uri, digest = ("WARC-Target-URI", target), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    answer = F.when(
        revisit,
        _record("revisit", main, "application/http; msgtype=response", status, uri, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _record_id("response", first, F.col("winner.row"), F.col("digest")))),
    ).otherwise(_record("response", main, "application/http; msgtype=response", F.concat(status, F.col("html")), uri, digest))
    role = lambda name: _record_id(name, F.col("page_id"), F.col("row"), F.col("digest"))
    asked = F.concat(F.lit("GET "), F.when(http_path == "", "/").otherwise(http_path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = _record("request", role("request"), "application/http; msgtype=request", asked, uri, ("WARC-Concurrent-To", main))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    fields = F.concat(field("page-id", F.col("page_id")), field("refers-to-page-id", F.when(revisit, first)))
    about = _record("metadata", role("metadata"), "application/warc-fields", fields, uri, ("WARC-Concurrent-To", main))
    out = rows.select(F.concat_ws(END, request, answer, about).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case, kind of record as warc-type) and block of each record."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive))) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    while first := f.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        yield headers, f.read(int(headers["content-length"]))


def _row(headers: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    kind, page_id, refers, size, digest, payload = headers["warc-type"], None, None, None, None, None
    if kind == "metadata":
        found = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
        page_id, refers = (int(found[x]) if x in found else None for x in ("page-id", "refers-to-page-id"))
    elif kind == "response":
        payload = block.partition(END.encode())[2]
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "revisit":  # the full payload's size is in the HTTP header, its digest in the record's
        http = dict(x.lower().split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
        size, digest = int(http["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    return kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), page_id, refers, size, digest, payload if keep_payload else None


def _reader(keep_payload: bool):
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORDS.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                rows, size = [], 0
                for headers, block in parse(content.as_py()):
                    rows.append(_row(headers, block, keep_payload))
                    size += len(block) if keep_payload else 0
                    if len(rows) >= 5000 or size > 1 << 23:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record: see RECORDS."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_reader(keep_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, page_id, response, request, metadata, refers_to (a page_id)."""
    answers = records.where("kind in ('response', 'revisit')")
    response = answers.select("record_id", F.struct("kind", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response"))

    def side(kind: str, *fields: str) -> DataFrame:
        return records.where(F.col("kind") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", *fields).alias(kind))

    captures = response.join(side("request", "target_uri"), "record_id", "left").join(side("metadata", "page_id", "refers_page"), "record_id", "left")
    return captures.withColumn("page_id", F.col("metadata.page_id")).withColumn("refers_to", F.col("metadata.refers_page"))


def write_and_read(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes archives under ``path``, reads them back and returns page_id, payload_bytes, payload_digest, record_type, refers_to. The archives stay."""
    write_archives(pages, path, id_col, url_col, html_col, least)
    captures = assemble(cut(read_archives(pages.sparkSession, path, keep_payload=False)))
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"), "refers_to")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    found = write_and_read(table(spark, sf_dir, "pages"), path)
    discard(spark, path)  # the records have been read
    return found


OP5_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
     h as (select page_id, strlen(html) as payload_bytes, sha1(html) as x from p),
     d as (select page_id, payload_bytes, translate({" || ".join(f"to_base(cast('0x' || substr(x, {1 + 5 * i}, 5) as bigint), 32, 4)" for i in range(8))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', '{BASE32}') as payload_digest from h),
     w as (select payload_digest, max(page_id) as winner from d group by 1)
select page_id, payload_bytes, payload_digest, case when winner is null or page_id = winner then 'response' else 'revisit' end as record_type,
       case when page_id = winner then null else winner end as refers_to from d join w using (payload_digest)
"""
