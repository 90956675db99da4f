"""WARC archives of pages, and the captures of all archives in the order of URL and time.

Writing: the first capture of a payload is a response record, later ones are revisits that refer to it. Records are strings
that Spark's text writer puts between the record separator, so archives lie in any store that Spark writes to.

Reading: each archive is parsed by its Content-Length fields and gives a run of its index, sorted by URL key and time. Runs
are cut at common bounds; a range's slices, one a run, meet in one task, where a tree of losers merges them. So nothing is
sorted as a whole, a hot URL is cut by its times, and a capture's position follows from the ranges' counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_folder, ship

#: Bytes of an archive as aimed at; captures of a merged range, and most ranges, for whose bounds the driver holds SAMPLES keys each.
ARCHIVE_BYTES, RANGE_ROWS, MOST_RANGES, SAMPLES = 32 << 20, 100_000, 20_000, 16
# The digits of base 32 by RFC 4648, those of Java's base 32, the profile of revisits, the version line.
BASE32, JAVA32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
#: Second of the first capture where pages have no times: 2024-01-01, UTC.
EPOCH = 1_704_067_200
CRLF = "\r\n"

_ENTRY = [
    ("url_key", pa.string()),
    ("captured", pa.string()),
    ("page_id", pa.int64()),
    ("payload_digest", pa.string()),
    ("archive", pa.string()),
    ("place", pa.int64()),
    ("size", pa.int64()),
    ("url", pa.string()),
    ("record_type", pa.string()),
    ("payload_bytes", pa.int64()),
    ("refers_to", pa.int64()),
]
_KEY = [name for name, _ in _ENTRY[:6]]
_DDL = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _ENTRY)
_NAMES = [name for name, _ in _ENTRY]


def base32_sha1(text: Column) -> Column:
    """SHA-1 of a string's UTF-8 in base 32, five hexadecimal digits to four characters."""
    digits = F.sha1(text)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), JAVA32, BASE32)


def utc(seconds: Column) -> Column:
    """ISO 8601 of seconds since 1970, whatever the session's zone."""
    of_day = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), two(of_day / 3600), F.lit(":"), two(F.pmod(of_day, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(of_day, F.lit(60))), F.lit("Z"))


def captures(pages: DataFrame, time: str | None = None) -> DataFrame:
    """(page_id, url, payload, captured, payload_digest, n_bytes, check) of each page."""
    seconds = F.col(time).cast("timestamp").cast("long") if time else EPOCH + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1 << 31))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), utc(F.coalesce(seconds, F.lit(EPOCH))).alias("captured"))
    return rows.select("*", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("check"))


def record(first: Column) -> Column:
    """The record of a capture: a revisit of the page ``first``, or a response if that is null."""
    named = lambda page: F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("payload_digest"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    again = first.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    body = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", named(F.col("page_id"))),
        line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),  # null: no such line
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, line("WARC-Refers-To", named(first))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    return F.concat(head, F.lit(CRLF + CRLF), body)


def write_archives(pages: DataFrame, folder: str, least: int = 0, time: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A WARC file a task and ``archive_bytes`` on average, a record a row of (page_id, url, html).

    Of equal payloads (by SHA-1 and SHA-256) of at least ``least`` bytes the smallest page_id is the response and others
    revisit it; smaller ones are all responses. Null html is an empty payload. Rows that repeat the smallest page_id are responses
    each; a row with a null page_id is a response only where no row with an id has its payload. Captures without ``time`` (a
    timestamp column) are dated by their id. A null url has no line; line breaks in one are escaped. Further columns are left out.
    """
    rows = captures(pages, time)
    groups = rows.groupBy("payload_digest", "check", "n_bytes").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    groups = materialise(groups, "payloads")
    n, size = groups.agg(F.sum("n"), F.sum(F.col("n") * F.col("n_bytes"))).first()
    # payloads that occur twice, stored: their true size decides whether pages move to meet them; adaptive execution splits hot ones
    shared = materialise(groups.filter(f"n > 1 and n_bytes >= {int(least)}").select("payload_digest", "check", "first"), "shared-payloads")
    joined = rows.join(shared, ["payload_digest", "check"], "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    most = max(1, int(archive_bytes * (n or 0) // max(size or 0, 1000 * (n or 0), 1)))
    joined.select(record(first)).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most).text(folder)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: com,example,www)/a?b; others as they are, null empty."""
    parts = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url or "")
    if not parts:
        return url or ""
    host = re.sub(r":[0-9]*$", "", parts[1].rpartition("@")[2]).lower()
    return ",".join(host.split(".")[::-1]) + ")" + ("" if parts[2].startswith("/") else "/") + parts[2]


def parse(content: bytes, archive: str) -> Iterator[tuple[dict, bytes]]:
    """The entry and the payload of each response and revisit of an archive; raises where that isn't whole."""
    at, view = 0, memoryview(content)
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at)
        lines = content[at:head_end].decode().split(CRLF) if head_end >= 0 else [""]
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        start = head_end + 4
        end = start + int(fields.get("content-length", -1))
        if not lines[0].startswith("WARC/") or end < start or content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no whole record at byte {at} of {archive}")
        kind = fields.get("warc-type")
        if kind in ("response", "revisit"):
            body = content.find(b"\r\n\r\n", start, end)
            http = {k.lower(): v for k, _, v in (x.partition(": ") for x in content[start:body].decode().split(CRLF)[1:])}
            payload = bytes(view[body + 4 : end])
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload at byte {at} of {archive} has another digest")
            page = lambda name: int(m[1]) if (m := re.match(r"<urn:capture:(-?\d+):", fields.get(name, ""))) else None
            url = fields.get("warc-target-uri")
            size = int(http["content-length"]) if kind == "revisit" else len(payload)
            values = (url_key(url), fields["warc-date"], page("warc-record-id"), digest, archive, at, end + 4 - at, url, kind, size, page("warc-refers-to"))
            yield dict(zip(_NAMES, values)), payload
        at = end + 4


def sort_key(entry: dict) -> tuple:
    page = entry["page_id"]
    return entry["url_key"], entry["captured"], page is None, page or 0, entry["payload_digest"], entry["archive"], entry["place"]


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The entry of each capture, those of an archive sorted by URL key and time; ``payload`` adds the bytes that the
    record has (a revisit has none)."""
    ship(spark)
    schema = pa.schema(_ENTRY + ([("payload", pa.binary())] if payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                found = [e | {"payload": p} if payload else e for e, p in parse(content.as_py(), path.as_py().rpartition("/")[2])]
                found.sort(key=sort_key)
                for lo in range(0, len(found), 10000):
                    yield pa.RecordBatch.from_pylist(found[lo : lo + 10000], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, _DDL + (", payload binary" if payload else ""))


class LoserTree:
    """Merges sorted lists: the inner nodes hold the losers of the games below them, the top the winner, so the next
    winner takes one game a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.next = [0] * self.k
        self.heads = [self.head(r) for r in range(self.k)]
        self.losers = [0] * max(self.k, 1)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if (self.heads[a], a) <= (self.heads[b], b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def head(self, run: int) -> tuple:
        """The next key of a run; a run that is over loses to all others."""
        at = self.next[run]
        return (0, self.runs[run][at]) if at < len(self.runs[run]) else (1,)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in the order of the keys."""
        while self.k and self.heads[self.winner][0] == 0:
            won = self.winner
            yield won, self.next[won]
            self.next[won] += 1
            self.heads[won] = self.head(won)
            node = (won + self.k) // 2
            while node:
                other = self.losers[node]
                if (self.heads[other], other) < (self.heads[won], won):
                    self.losers[node], won = won, other
                node //= 2
            self.winner = won


def merged(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The entries of ``index`` with their ``position`` in the order of URL key, time, page (null last), digest and place.

    Bounds come from a sample of keys by hash, at most SAMPLES * MOST_RANGES; they only deal the rows, all of which are merged.
    """
    n = index.count()
    ranges = min(MOST_RANGES, max(1, -(-n // range_rows)))
    share = min(1.0, SAMPLES * ranges / max(n, 1))
    drawn = index.filter(F.pmod(F.xxhash64("archive", "place"), F.lit(1 << 30)) < int(share * (1 << 30))) if ranges > 1 else index.limit(0)
    keys = sorted(sort_key(r.asDict()) for r in drawn.select(*_KEY).collect())
    bounds = keys[SAMPLES // 2 :: SAMPLES]
    entries = pa.list_(pa.struct(_ENTRY))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for _, run in groupby(rows, lambda e: e["archive"]):  # a sorted run, or a part of one
                run = list(run)
                own = [sort_key(e) for e in run]
                cuts = sorted({0, len(run), *(bisect_left(own, b) for b in bounds[bisect_left(bounds, own[0]) : bisect_left(bounds, own[-1]) + 1])})
                pieces = [(bisect_right(bounds, own[a]), run[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.int32()), pa.array([e for _, e in pieces], entries)], ["part", "entries"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        runs = [[sort_key(e) for e in run] for run in table.column("entries").to_pylist()]
        first = [0]
        for run in runs:
            first.append(first[-1] + len(run))
        order = [first[run] + at for run, at in LoserTree(runs)]
        flat = pa.chunked_array([c.flatten() for c in table.column("entries").chunks], pa.struct(_ENTRY)).take(pa.array(order, pa.int64()))
        rows = pa.Table.from_struct_array(flat)
        return rows.append_column("part", pa.array([key[0].as_py()] * len(order), pa.int32())).append_column("at", pa.array(range(len(order)), pa.int64()))

    ddl = ",".join(f"{a}:{b}" for a, b in (x.split() for x in _DDL.split(", ")))
    cut = index.select(*_NAMES).mapInArrow(slices, f"part int, entries array<struct<{ddl}>>")
    rows = materialise(cut.groupBy("part").applyInArrow(merge, f"{_DDL}, part int, at long"), "merged")
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # MOST_RANGES rows
    return rows.join(F.broadcast(offsets), "part").select(*_NAMES, (F.col("offset") + F.col("at")).alias("position"))


def histories(spark: SparkSession, folder: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all archives of a folder, with their position in the order of URL key and time."""
    return merged(materialise(read_archives(spark, folder), "capture-index"), range_rows)


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The captures with their payloads; a revisit has that of the response it refers to."""
    rows = materialise(read_archives(spark, folder, payload=True), "records")
    responses = rows.filter("record_type = 'response'")
    first = responses.join(rows.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), ["page_id", "payload_digest"], "left_semi")
    first = first.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("payload"))  # equal ones
    again = rows.filter("record_type = 'revisit'").drop("payload").join(first, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(again.select(*responses.columns))


def digest(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder, and reads them back by their merged index."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return histories(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


def _oracle() -> str:
    groups = " || ".join(f"substr(d, v{k // 4 + 1} // {32 ** (3 - k % 4)} % 32 + 1, 1)" for k in range(32))
    values = ", ".join(f"cast('0x' || substr(h, {5 * k + 1}, 5) as integer) as v{k + 1}" for k in range(8))
    start = "[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"
    return f"""
with p as (select page_id, coalesce(html, '') as payload, url, sha1(coalesce(html, '')) as h, '{BASE32}' as d,
                  regexp_extract(url, '^{start}', 1) as host, regexp_extract(url, '^{start}', 2) as rest from pages),
     q as (select *, {values}, min(page_id) over (partition by payload) as first from p),
     r as (select *, {groups} as payload_digest,
                  case when url is null then '' when not regexp_matches(url, '^{start}') then url else
                  array_to_string(list_reverse(string_split(lower(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')), '.')), ',') || ')' ||
                  case when rest like '/%' then rest else '/' || rest end end as url_key from q)
select page_id, cast(strlen(payload) as bigint) as payload_bytes, payload_digest,
       case when page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to, url_key,
       row_number() over (order by url_key, coalesce(page_id, 0) % {1 << 31}, page_id, payload_digest) - 1 as position
from r
"""


ORACLE = _oracle()
