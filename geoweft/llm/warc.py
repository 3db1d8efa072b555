"""Operator 3: WARC archives and their capture index.

Writing: a WARC/1.1 record per page, its block an HTTP response with the html
in UTF-8. Of pages with equal payloads of at least MIN_REVISIT bytes the one
with the smallest page_id is a response record, the others are revisit records
without payload. Spark's text sink writes the archives, gzip by file, with the
record terminator as its line separator.

Reading: archives are read as binary files and parsed by Content-Length.

Index: every archive gives a run of captures, sorted by URL key (host labels
reversed, then path and query) and timestamp, and stored. Runs are dealt by key
ranges of about RANGE captures, however many those are; in each range a loser
tree merges the runs, so that partitions, one after the other, are the globally
ordered capture history. A range sees the captures of its keys only, without
payloads; a run out of order is an error.

Defined cases: null html is an empty payload, so always a response; null url
has the empty key; a null page_id comes after all others; rows are captures
each, whatever page_ids they share: of the rows of a payload, the one with the
smallest page_id, of ties any one, is the response, and a row revisits its own
payload only (its refers_to is null if no row of it has a page_id); an empty
table writes an empty folder and reads back no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import pairwise
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm.common import looked_up, shuffle_partitions, staged, temporary

MIN_REVISIT = 100
#: Records a file at most, and about the payload bytes of one; captures in a key range.
RECORDS_PER_FILE, FILE_BYTES, RANGE = 2000, 64 << 20, 100_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: WARC/1.1 record types, profile and terminator.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def stored_pages(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, html, digest, bytes) of every page, stored: each row has a number and each payload is hashed once."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    return staged(rows, "warc-pages", compression="zstd")


def revisits(rows: DataFrame) -> DataFrame:
    """(row, refers_to) of the rows to be stored as revisits. Only digests, ids and numbers are shuffled."""
    large = rows.where(F.col("bytes") >= MIN_REVISIT).select("row", "page_id", "digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("leader"), "n")
    found = looked_up(large, staged(first, "warc-first"), ["digest"], "n", rows.count())
    return found.where("row <> leader").select("row", "refers_to")


def records(rows: DataFrame) -> DataFrame:
    """One text column: the WARC record of each row of stored_pages(), without its terminator."""
    later = revisits(rows).select(F.col("row").alias("later"), "refers_to", F.lit(True).alias("again"))
    rows = rows.join(later, rows["row"] == later["later"], "left")
    nl = "\r\n"
    body = F.coalesce("html", F.lit(""))
    size = F.col("bytes").cast("string")
    again = F.coalesce("again", F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), size, F.lit(nl * 2))
    block = F.when(again, http).otherwise(F.concat(http, body))
    when = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce(F.col("page_id").cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    one_line = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    head = F.concat(
        F.lit(f"WARC/1.1{nl}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{nl}WARC-Record-ID: <urn:page:"), name, F.lit(">"),
        F.lit(f"{nl}WARC-Date: "), when,
        F.lit(f"{nl}WARC-Target-URI: "), one_line,
        F.lit(f"{nl}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{nl}X-Payload-Length: "), size,
        F.when(again, F.concat(F.lit(f"{nl}WARC-Profile: {PROFILE}{nl}WARC-Refers-To: <urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("null")), F.lit(">"))).otherwise(""),
        F.lit(f"{nl}Content-Type: application/http; msgtype=response{nl}Content-Length: "), F.octet_length(F.encode(block, "utf-8")).cast("string"), F.lit(nl * 2),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, out: str) -> None:
    """Archives of RECORDS_PER_FILE records, fewer where pages are large, so that a file is one task's work to read."""
    with temporary(pages.sparkSession):
        rows = stored_pages(pages)
        usual = rows.agg(F.avg("bytes")).first()[0] or 0
        most = max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / (usual + 500))))
        records(rows).write.options(lineSep=END, compression="gzip", maxRecordsPerFile=most).text(out)


def url_key(url: str) -> str:
    """Host labels reversed and comma-joined, then path and query, in lower case: com,example,www)/a?b."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return key.lower()


def parsed(data: bytes) -> Iterator[dict[str, object]]:
    """The records of one archive: headers, payload, offset and length in the uncompressed file."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.index(end, at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        begin = stop + len(end)
        block = data[begin : begin + int(head["content-length"])]
        after = begin + len(block) + len(end)
        if not lines[0].startswith("WARC/") or data[after - len(end) : after] != end:
            raise ValueError(f"no WARC record at {at}")
        yield {"head": head, "payload": block[block.index(end) + len(end) :], "offset": at, "length": after - at}
        at = after


CAPTURES = "file string, urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long, place long"
NAMES = [x.split(" ")[0] for x in CAPTURES.split(", ")]
TYPES = [pa.int64() if x.endswith(" long") else pa.string() for x in CAPTURES.split(", ")]


def _page(reference: str | None) -> int | None:
    x = (reference or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x not in ("", "null") else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive, a locally sorted run. Digests of stored payloads are checked."""
    for batch in batches:
        for i in range(batch.num_rows):
            run = []
            data = batch.column(1)[i].as_buffer()
            for r in parsed(gzip.decompress(data)):
                head = r["head"]
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                size = int(head["x-payload-length"])
                if head["warc-type"] == "response" and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != size):
                    raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                stamp = head["warc-date"].translate({ord(c): None for c in "-:TZ"})
                run.append((batch.column(0)[i].as_py(), url_key(head["warc-target-uri"]), stamp, _page(head["warc-record-id"]), size, digest, head["warc-type"], _page(head.get("warc-refers-to")), r["offset"], r["length"]))
            run.sort(key=_order)
            if run:
                yield _batch([(*capture, place) for place, capture in enumerate(run)], NAMES)


def _batch(captures: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*captures), TYPES)], names=names)


def _order(capture: tuple) -> tuple:
    return capture[1], capture[2], -1 if capture[3] is None else capture[3], capture[0], capture[8]


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, so each step replays one path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.heads = [_order(r[0]) if r else None for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = _order(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of one key range, which come one after the other in their order."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for capture in zip(*(c.to_pylist() for c in batch.columns[:-1])):
            runs.setdefault(capture[0], []).append(capture)
    for name, run in runs.items():
        if any(_order(a) > _order(b) for a, b in pairwise(run)):
            raise ValueError(f"the run of {name} is out of order")
    out: list[tuple] = []
    for capture in LoserTree(list(runs.values())):
        out.append(capture)
        if len(out) == 10_000:
            yield _batch(out, NAMES[:-1])
            out = []
    if out:
        yield _batch(out, NAMES[:-1])


def capture_index(spark: SparkSession, archives: str, captures: int = RANGE) -> DataFrame:
    """All captures of the archives in one order by URL key and timestamp."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(archives).select("path", "content")
    runs = staged(files.mapInArrow(_runs, CAPTURES), "warc-runs")
    ranges = max(shuffle_partitions(spark), -(-runs.count() // captures))
    # All order columns: neither a key nor a capture that holds a large part of all is one range.
    ranges_ = runs.repartitionByRange(ranges, "urlkey", "timestamp", "page_id", "file", "offset").sortWithinPartitions("file", "place")
    return ranges_.mapInArrow(_merge, CAPTURES.rpartition(",")[0])


def page_time(page_id: int) -> datetime:
    """The capture time that the archives give a page."""
    return EPOCH + timedelta(seconds=page_id)


#: What the archives of pages hold, from the pages themselves.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest, row_number() OVER (PARTITION BY sha256(h) ORDER BY page_id NULLS LAST) AS place, min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND place > 1 THEN first END AS refers_to,
  strftime(to_timestamp({int(EPOCH.timestamp())} + page_id) AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS timestamp
FROM d
"""
