"""WARC records in Spark: reading, and resolving not-modified revisits (a join to the latest earlier full response).

A revisit record says that a server answered 304, or that a payload was seen before; its body is elsewhere. resolve()
finds, for each revisit, the latest earlier full response of the same canonical URL, checks that a validator agrees (ETag, or else
Last-Modified, or else the payload digest), and merges the headers: those of the response, replaced by those that a 304
may carry.

The join is as-of: rows of one URL and time are summed up first; the times of one URL are cut into buckets of bounded size, finer where
they are denser; each bucket knows the last response before it from the buckets' summaries, so a URL with any share of all
rows, and any burst of them, is spread over many tasks.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Times of one URL in a bucket, at most; a bucket with more is cut into up to CELLS even parts, and those again, LEVELS times.
BUCKET_ROWS, CELLS, LEVELS = 4_000, 4_096, 5
#: Records and bytes of bodies that are given out at once.
GIVEN, GIVEN_BYTES = 256, 16 << 20
# Headers that a 304 response may carry for the stored response (RFC 9111, 9110), lower-cased.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning"]
# Parameters that only name where a visitor came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"

SCHEMA = "record_id string, type string, uri string, date string, digest string, refers_to string, status int, headers map<string,string>, body binary, file string, offset long, error string"


def canonical_url(url: Column) -> Column:
    """A URL's canonical form: no scheme, user, fragment, default port, `www.` or `m.`; lower-cased host; sorted query without
    tracking parameters; no slash or `.html` at the path's end."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^(?:[^/?@]*@)?([^/?]*)", 1)), r"(^(?:www|m)\.)|(:(?:80|443)$)", "")
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"(?:\.html?|/)+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(rf"^(?:{TRACKING})(?:=|$)"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))


_LENGTH = re.compile(r"[0-9]{1,15}")
_STATUS = re.compile(r"[0-9]{3}")


class _Inflated(io.RawIOBase):
    """The contents of gzip members one after the other, as far as they can be read; error says why no further."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.error = memoryview(raw), 0, ""
        self.member, self.left = zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left and not self.error and (self.at < len(self.raw) or self.member.unconsumed_tail):
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
                continue
            chunk = self.member.unconsumed_tail or self.raw[self.at : self.at + (1 << 16)]
            self.at += 0 if self.member.unconsumed_tail else len(chunk)
            try:
                self.left = self.member.decompress(chunk, 1 << 20)
            except zlib.error:
                self.error = "damaged gzip"
            if self.member.eof and self.member.unused_data:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
        if not self.left and not self.error and not self.member.eof and len(self.raw):
            self.error = "gzip cut short"
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


def _records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Offset, header, block and error of each record of a WARC file, gzipped by record or plain.

    What is damaged (no gzip, a record cut short, a length that is none) ends the file: its record comes last, with an error and what
    could be read of it.
    """
    packed = _Inflated(raw) if raw[:2] == b"\x1f\x8b" else None
    stream = io.BufferedReader(packed) if packed else io.BytesIO(raw)
    at = 0
    while line := stream.readline():
        begin, at = at, at + len(line)
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        at += len(line)
        length = head.get("content-length", "")
        if not _LENGTH.fullmatch(length):
            yield begin, head, b"", packed and packed.error or "no content-length"
            return
        block = stream.read(int(length))
        at += len(block)
        if len(block) < int(length):
            yield begin, head, block, packed and packed.error or "cut short"
            return
        yield begin, head, block, None
    if packed and packed.error:
        yield at, {}, b"", packed.error


def _http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers (lower-cased names, repeated ones joined by a comma) and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    parts = first.split(" ")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return int(parts[1]) if len(parts) > 1 and _STATUS.fullmatch(parts[1]) else None, headers, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows SCHEMA, one for each response, revisit or resource record of WARC files (plain or .gz), a file of up to 2 GB in one task each.

    Of a damaged file the records before the damage are given, and last a row, of any record type, whose `error` says what is wrong
    (null in all others). A status that is none is null. Records are given out GIVEN at a time. An empty file gives no rows.
    """
    names = [c.strip().split(" ")[0] for c in SCHEMA.replace("map<string,string>", "map").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for offset, head, block, error in _records(raw):
                    if error or head.get("warc-type") in ("response", "revisit", "resource"):
                        status, headers, body = _http(block) if "http" in head.get("content-type", "") else (None, {}, block)
                        rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri", "").strip("<>") or None, head.get("warc-date"), head.get("warc-payload-digest"), head.get("warc-refers-to"), status, headers, body, file, offset, error))
                        held += len(body)
                    if len(rows) == GIVEN or held > GIVEN_BYTES:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"status": "Int32"})


def _buckets(times: DataFrame) -> DataFrame:
    """times (url, at, ...), each once, with `__bucket`, growing with time within a URL, of up to BUCKET_ROWS times.

    A bucket with more is cut into even stretches of time, those with more again. Counts are summed up before they are shuffled.
    """
    spark, before = times.sparkSession, None
    cut = times.withColumn("__bucket", F.lit(0).cast("long"))
    for _ in range(LEVELS):
        cut, path = shared.write_table(cut, "asof")
        if before:
            shared.drop_tables(spark, before)
        before = path
        sizes = cut.groupBy("url", "__bucket").agg(F.count("*").alias("__n"), F.min("at").alias("__from"), F.max("at").alias("__to")).where(f"__n > {BUCKET_ROWS}")
        sizes, sizes_path = shared.write_table(sizes, "hot-urls")
        if sizes.isEmpty():
            return cut
        cells = F.least(F.ceil(2 * F.col("__n") / BUCKET_ROWS), F.lit(CELLS))
        cell = F.floor((F.col("at") - F.col("__from")).cast("decimal(20,0)") * cells / (F.col("__to") - F.col("__from") + 1).cast("decimal(20,0)"))
        other = shared.small(sizes.withColumnsRenamed({"url": "__url", "__bucket": "__in"}))
        met = cut.join(other, (F.col("url") == F.col("__url")) & (F.col("__bucket") == F.col("__in")), "left")
        cut = met.withColumn("__bucket", F.col("__bucket") * CELLS + F.coalesce(cell.cast("long"), F.lit(0).cast("long"))).drop("__url", "__in", "__n", "__from", "__to")
    return cut  # as fine as CELLS ** LEVELS cells of a URL's whole time


def latest_before(rows: DataFrame) -> DataFrame:
    """Rows (url, at, base) for each url and time of a row (url, at, id, full) that is not full: the id of the latest full row earlier than at.

    Of several full rows at one time the one with the largest id counts; null where there is none. full: boolean; at: long; id: any ordered type.
    """
    full = F.max(F.when(F.col("full"), F.col("id"))).alias("id")
    times = rows.groupBy("url", "at").agg(full, F.max(F.when(F.col("full"), F.col("at"))).alias("full_at"), F.max((~F.col("full")).cast("int")).alias("asks"))
    cut = _buckets(times)
    last = F.max(F.when(F.col("full_at").isNotNull(), F.struct("at", "id")))
    ends = cut.groupBy("url", "__bucket").agg(last.alias("last"), F.max("asks").alias("asks"))
    earlier = Window.partitionBy("url").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "__bucket", F.max("last").over(earlier).alias("__carried"), "asks").where("asks = 1").drop("asks")
    within = Window.partitionBy("url", "__bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("__own", last.over(within)).where("asks = 1")
    return own.join(carried, ["url", "__bucket"]).select("url", "at", F.coalesce("__own.id", "__carried.id").alias("base"))


def resolve(records: DataFrame) -> DataFrame:
    """Revisits of records (id, uri, at long, type, etag, last_modified, digest, headers map) with what they stand for.

    Rows (id, url, base, validator, resolved, headers): base is the latest earlier full response (type `response`) of the
    canonical url, null if none; validator the first of etag, last-modified, digest that both have, or `none`; resolved whether it
    agrees (weak and strong ETags of one value agree); headers, where resolved, the response's with PERMITTED ones of the revisit in place
    of them, else the revisit's. A null uri or time resolves nothing. Repeated rows are resolved one by one; an empty table gives
    an empty table.
    """
    named = records.withColumn("url", canonical_url(F.col("uri")))
    slim = named.where(F.col("url").isNotNull() & F.col("at").isNotNull()).select("url", "at", "id", (F.col("type") == "response").alias("full"), F.col("type").alias("__type"))
    asof = latest_before(slim.where(F.col("full") | (F.col("__type") == "revisit")).drop("__type"))
    asks = named.where(F.col("type") == "revisit").select(F.col("id").alias("rid"), F.col("url").alias("rurl"), F.col("at").alias("rat"), F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"), F.col("digest").alias("r_digest"), F.col("headers").alias("r_headers"))
    found = asks.join(asof, (F.col("rurl") == F.col("url")) & (F.col("rat") == F.col("at")), "left").drop("url", "at")
    full = records.where(F.col("type") == "response").select(F.col("id").alias("bid"), F.col("at").alias("bat"), F.col("etag").alias("b_etag"), F.col("last_modified").alias("b_modified"), F.col("digest").alias("b_digest"), F.col("headers").alias("b_headers"))
    both = found.join(full.dropDuplicates(["bid"]), F.col("base") == F.col("bid"), "left")
    weak = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    tests = [("etag", weak(F.col("r_etag")), weak(F.col("b_etag"))), ("last-modified", F.trim("r_modified"), F.trim("b_modified")), ("digest", F.col("r_digest"), F.col("b_digest"))]
    validator = F.coalesce(*(F.when(x.isNotNull() & y.isNotNull(), F.lit(n)) for n, x, y in tests), F.lit("none"))
    agrees = F.coalesce(*(F.when(x.isNotNull() & y.isNotNull(), x == y) for _, x, y in tests), F.lit(False)) & F.col("bid").isNotNull()
    allowed = F.map_filter(F.coalesce("r_headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k).isin(PERMITTED))
    stored = F.map_filter(F.coalesce("b_headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    out = both.withColumn("validator", validator).withColumn("resolved", agrees)
    return out.select(F.col("rid").alias("id"), F.col("rurl").alias("url"), "base", "validator", "resolved", F.when(F.col("resolved"), F.map_concat(stored, allowed)).otherwise(F.col("r_headers")).alias("headers"))


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", after: int = 1_000) -> DataFrame:
    """Records as a crawler would have them that fetched each page at the second page_id and asked again `after` seconds later.

    The response's ETag is its body's digest; the second answer is a 304 with the ETag of the first, but each seventh page has changed
    meanwhile and says so by another ETag, and each fifth has no ETag, only its date.
    """
    p = F.col(page_id)
    base = pages.select(p.alias("page"), F.col(url).alias("uri"), F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("digest"))
    etag = F.when(F.col("page") % 5 != 0, F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')))
    modified = F.concat(F.lit("t"), F.col("page").cast("string"))
    text = lambda c: c.cast("string")
    response = base.select((F.col("page") * 2).alias("id"), "uri", F.col("page").alias("at"), F.lit("response").alias("type"), etag.alias("etag"), modified.alias("last_modified"), "digest", F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), text(F.col("page"))).alias("headers"))
    changed = F.when(F.col("page") % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), etag))
    revisit = base.select((F.col("page") * 2 + 1).alias("id"), "uri", (F.col("page") + after).alias("at"), F.lit("revisit").alias("type"), F.when(F.col("page") % 5 != 0, changed).alias("etag"), modified.alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map(F.lit("date"), text(F.col("page") + after), F.lit("server"), F.lit("unit"), F.lit("expires"), text(F.col("page") + 2 * after)).alias("headers"))
    return response.unionByName(revisit)
