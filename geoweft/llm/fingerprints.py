"""Operator 2: document fingerprints from prefix polynomial hashes.

A text's code points c_j give prefix arrays P_i = sum of c_j * B^j for j < i,
modulo 2^31 - 1, for two bases. (P_b - P_a) / B^a is then the hash of the span
a..b wherever it lies, so any two spans are compared in constant time and the
longest common extension of two positions is found by binary search.

A fingerprint holds the length and hash of the whole text and the K smallest
hashes of its spans of SPAN code points, all read off the prefix arrays. The
likeness of two fingerprints is the share of spans they have in common,
2j / (1 + j) for the resemblance j that the K smallest of the union show: 1
for equal fingerprints, near one half after half a text was replaced.

Defined cases: null text is the empty text; texts shorter than a span are one
span; two empty texts are alike (1), an empty and another are not (0);
rows of one doc_id, or none, follow each other in an order of their texts'
hashes; a table of one row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions.running import bucket_of, order_buckets
from geoweft.llm.common import shuffle_partitions, text_slices

MODULUS = np.uint64((1 << 31) - 1)
SHIFT, LIFT = np.uint64(31), np.uint64((1 << 32) - 2)
BASES = (911382323, 972663749)
SPAN, SMALLEST = 16, 64
#: Code points that are in work at a time; whole arrays have four bytes for each.
STRETCH = 1 << 20


def _folded(x: np.ndarray) -> np.ndarray:
    """A number below 2^31 + 4 that equals x, below 2^63, modulo 2^31 - 1."""
    x = (x & MODULUS) + (x >> SHIFT)
    return (x & MODULUS) + (x >> SHIFT)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^63."""
    x = _folded(x)
    return np.where(x >= MODULUS, x - MODULUS, x)


class Powers:
    """Powers of a base and of its inverse, as far as some text has asked for."""

    def __init__(self, base: int):
        self.base = (base, pow(base, -1, int(MODULUS)))
        self.up, self.down = (np.ones(1, np.uint32) for _ in range(2))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = min(len(self.up), STRETCH)  # the last k powers times base^k are the next k
            self.up, self.down = (np.concatenate([x, _mod(x[-k:] * np.uint64(pow(b, k, int(MODULUS)))).astype(np.uint32)]) for x, b in zip((self.up, self.down), self.base))
        return self.up, self.down


class PrefixHashes:
    """The prefix arrays of one text (an array of code points)."""

    tables = tuple(Powers(b) for b in BASES)

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.prefix, self.down = [], []
        for t in self.tables:
            up, down = t.upto(self.n + 1)
            prefix, carried = np.zeros(self.n + 1, np.uint32), np.uint64(0)
            for at in range(0, self.n, STRETCH):
                part = (points[at : at + STRETCH] + np.uint64(1)) * up[at : at + len(points[at : at + STRETCH])]
                part = _folded(np.cumsum((part & MODULUS) + (part >> SHIFT)) + carried)
                prefix[at + 1 : at + 1 + len(part)], carried = part, part[-1]
            self.prefix.append(prefix)
            self.down.append(down)

    def spans(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """62-bit hashes of the spans starts..ends, the same wherever a span lies."""
        out = []
        for p, down in zip(self.prefix, self.down):
            out.append(_mod((p[ends] + LIFT - p[starts]) * down[: self.n + 1][starts]))
        return (out[0] << SHIFT) | out[1]

    def scrambled(self) -> np.ndarray:
        """32 bits of each span of SPAN code points, in an order unrelated to that of the texts."""
        starts = self.n - SPAN + 1
        parts = [_scrambled(self.spans(slice(at, min(at + STRETCH, starts)), slice(at + SPAN, min(at + STRETCH, starts) + SPAN))) for at in range(0, starts, STRETCH)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def span(self, a: int, b: int) -> int:
        m, out = int(MODULUS), 0
        for p, down in zip(self.prefix, self.down):
            out = out << 31 | (int(p[b]) - int(p[a])) % m * int(down[a]) % m
        return out

    def joined(self, a: int, other: PrefixHashes, b: int) -> int:
        """Hash of the first a code points of this text followed by the first b of other."""
        m, out = int(MODULUS), 0
        for p, q, t in zip(self.prefix, other.prefix, self.tables):
            out = out << 31 | (int(p[a]) + int(q[b]) * int(t.up[a])) % m
        return out

    def common(self, a: int, other: PrefixHashes, b: int) -> int:
        """Length of the longest common extension of position a here and b in other, by binary search."""
        lo, hi = 0, min(self.n - a, other.n - b)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.span(a, a + mid) == other.span(b, b + mid) else (lo, mid - 1)
        return lo


def _scrambled(hashes: np.ndarray) -> np.ndarray:
    """32 bits whose order is unrelated to that of the texts."""
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


class Fingerprint:
    __slots__ = ("n", "smallest", "whole")

    def __init__(self, n: int, whole: int, found: np.ndarray):
        """found: scrambled hashes of all spans."""
        self.n, self.whole = n, whole
        few = 2 * SMALLEST
        while True:  # repeats may fill the first places
            part = np.unique(np.partition(found, few)[:few] if len(found) > few else found)
            if len(part) >= SMALLEST or len(found) <= few:
                break
            few *= 4
        self.smallest = part[:SMALLEST]

    def text(self) -> str:
        """All of it: length, whole hash and span hashes, in hexadecimal digits."""
        return f"{self.n:x}-{self.whole:016x}-{self.smallest.astype('>u4').tobytes().hex()}"

    def likeness(self, other: Fingerprint) -> float:
        a, b = self.smallest, other.smallest
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        union = np.union1d(a, b)[:SMALLEST]
        j = np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()
        return float(2 * j / (1 + j))


class Document:
    """A text with its prefix arrays, the hashes of its spans, and its fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.hashes = h = PrefixHashes(points_of(text))
        whole = h.span(0, h.n)
        self.found = _spans_of(h, whole)
        self.print = Fingerprint(h.n, whole, self.found)

    def edited(self, following: Document) -> tuple[str, Fingerprint, int]:
        """The edited text, its fingerprint, and how far this text and it agree.

        Nothing of it is hashed again: its spans are this text's up to the cut,
        the following text's after it, and the few that lie across.
        """
        n, m = self.hashes.n, following.hashes.n
        half = n // 2
        cut, tail = n - half, min(half, m)
        text = self.text[:cut] + following.text[:tail]
        whole = self.hashes.joined(cut, following.hashes, tail)
        if cut + tail <= SPAN:
            found = _scrambled(np.array([whole] if text else [], np.uint64))
        else:
            low = max(0, cut - SPAN + 1)
            across = PrefixHashes(points_of(text[low : cut + SPAN - 1]))
            parts = [self.found[:low], following.found[: max(0, tail - SPAN + 1)]]
            parts.append(across.scrambled())
            found = np.concatenate(parts)
        agree = cut + min(tail, self.hashes.common(cut, following.hashes, 0))
        return text, Fingerprint(cut + tail, whole, found), agree


def _spans_of(h: PrefixHashes, whole: int) -> np.ndarray:
    if h.n > SPAN:
        return h.scrambled()
    return _scrambled(np.array([whole] if h.n else [], np.uint64))


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, text, guest) in order: each against the one after it in its bucket.

    The last row of a bucket is a guest, the first of the next bucket, and is compared with nothing.
    """
    names = ["doc_id", *(x.split(" ")[0] for x in OUT.split(", "))]
    before: tuple | None = None
    kind: pa.DataType | None = None
    for part in text_slices(batches, text=2):
        kind = part.column(1).type
        rows: list[tuple] = []
        for bucket, doc_id, text, guest in zip(*(c.to_pylist() for c in part.columns)):
            document = Document(text or "")
            if before is not None and before[0] == bucket and not before[3]:
                rows.append(_row(before[1], before[2], document))
            before = (bucket, doc_id, document, guest)
        if rows:
            columns = list(zip(*rows))
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=names)


def _row(doc_id: object, own: Document, following: Document) -> tuple:
    text, print_, agree = own.edited(following)
    return (
        doc_id,
        own.hashes.n,
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        own.print.text(),
        print_.text(),
        own.print.likeness(print_),
        own.print.likeness(following.print),
        agree,
        own.hashes.common(0, following.hashes, 0),
    )


def _split_ranges(dealt: DataFrame, ranges: int) -> DataFrame:
    """dealt (bucket, doc_id, h and more) with buckets that are one doc_id and large cut up by h. The larger bucket is the earlier one."""
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()  # three numbers for each range
    usual = sum(r.n for r in sizes) / max(1, ranges)
    part = F.lit(0)
    for r in sizes:
        if r.low == r.high and r.n > 2 * usual:
            parts = min(1 << 15, round(r.n / usual))
            part = F.when(F.col("bucket") == r.bucket, F.floor((F.col("h") / 2.0**64 + 0.5) * parts).cast("int")).otherwise(part)
    return dealt.withColumn("bucket", F.col("bucket").cast("long") * (1 << 16) + (1 << 15) - part)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and how near they and the next document's are.

    The next document is the one before in doc_id (after the smallest: the
    largest). Documents are dealt by ranges of doc_id, each range in one
    sorted stretch with the first document of the next range as its guest;
    the text moves once, and guests are as few as the ranges.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    n = shuffle_partitions(spark)
    splits = order_buckets(docs.select("doc_id"), "doc_id", 4 * n)
    order = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    dealt = _split_ranges(docs.select(bucket_of(F.col("doc_id"), splits).alias("bucket"), "doc_id", order, "text"), 4 * n)
    # First of each range in descending order: the largest doc_id and of its rows the first by hash, here with all bits turned.
    tops = dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("top")).collect()  # two numbers for each range
    tops = sorted(((r.bucket, r.top.doc_id, ~r.top.h) for r in tops), key=lambda r: -r[0])
    if not tops:
        return spark.createDataFrame([], f"doc_id {kind}, {OUT}")
    # A guest goes to the range before its own; that of the first range to the last.
    hosts = [(b, i, h, tops[k - 1][0]) for k, (b, i, h) in enumerate(tops)]
    hosts = F.broadcast(spark.createDataFrame(hosts, f"bucket long, top {kind}, top_h long, host long"))  # a row for each range
    guests = dealt.join(hosts, (dealt["bucket"] == hosts["bucket"]) & dealt["doc_id"].eqNullSafe(hosts["top"]) & (F.col("h") == F.col("top_h")))
    guests = guests.groupBy("host", "doc_id", "h").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    guests = guests.select(F.col("host").alias("bucket"), "doc_id", "h", "text", F.lit(True).alias("guest"))
    rows = dealt.select("bucket", "doc_id", "h", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("guest")).unionByName(guests)
    rows = rows.repartition(n, "bucket").sortWithinPartitions(F.col("bucket").desc(), "guest", F.col("doc_id").desc_nulls_last(), "h", "text")
    return rows.select("bucket", "doc_id", "text", "guest").mapInArrow(_compare, f"doc_id {kind}, {OUT}")
