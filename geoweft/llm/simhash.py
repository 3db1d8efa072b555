"""Operator 6: SimHash near-duplicates by anchor-point covering.

Anchors are the words of a linear code of length 64: the evaluations of the
first k monomials of degree two at most in six variables, hence between the
first and the second order Reed-Muller code (covering radius 28 to 18). Let
r(x) be the distance of fingerprint x to its nearest anchor, its home. Every
fingerprint is copied to all anchors within r(x) + threshold. For a pair at
most threshold apart and r(x) <= r(y), the home of x is within r(x) +
threshold <= r(y) + threshold of y, so the two meet there: no link is lost,
whatever the code, and an anchor compares its home fingerprints with its
copies only. k grows with the number of distinct fingerprints (about half its
logarithm), which holds assigning and comparing in balance.

Equal fingerprints are one before any of this. An anchor with many
fingerprints is dealt out as tiles of about TILE homes by WIDE * TILE copies,
whose sizes come from one count for each anchor; fingerprints travel packed in
arrays, and a tile passes on a spanning forest of its links, never all pairs.

Defined cases: null and wordless texts have fingerprint zero and link like any
other; a text shorter than a shingle is one shingle; rows that repeat a doc_id
are rows of their own, with that doc_id; a null doc_id is never the smallest
unless all of its component are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import free_name, numbered, staged, text_slices
from geoweft.operators.components import connected_components

SEED, WORDS, BITS = 42, 4, 4
TILE, WIDE = 1024, 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + np.arange(len(found))
    width = min(words, len(found))
    lo = np.concatenate([[0], ends[: len(found) - width] + 1]).tolist()
    hi = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(lo, hi)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the shingles' XXH64, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp: the 64 bits as a signed long) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            fps = np.array([fingerprint(x or "", words) for x in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


@lru_cache(maxsize=4)
def anchors(k: int) -> np.ndarray:
    """The 2^k words spanned by the first k monomials: one, six variables, fifteen products."""
    point = np.arange(64, dtype=np.uint64)
    x = [(point >> np.uint64(i)) & np.uint64(1) for i in range(6)]
    pairs = sorted(((i, j) for i in range(6) for j in range(i)), key=lambda p: ((p[0] - p[1]) % 2 == 0, p))
    rows = [np.ones(64, np.uint64), *x, *(x[i] & x[j] for i, j in pairs)]
    words = np.zeros(1, np.uint64)
    for row in rows[:k]:
        words = np.concatenate([words, words ^ np.bitwise_or.reduce(row << point)])
    return words


def code_size(distinct: int) -> int:
    """k for so many distinct fingerprints."""
    return min(22, max(7, round(math.log2(max(1, 30 * distinct)) / 2)))


def copies(own: np.ndarray, k: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, fp, home) arrays, a stretch of fingerprints at a time: each fingerprint at every anchor that it may meet a neighbour at."""
    code = anchors(k)
    step = max(1, (1 << 21) >> k)
    for at in range(0, len(own), step):
        part = own[at : at + step]
        d = np.bitwise_count(part[:, None] ^ code[None, :])
        home = d.argmin(axis=1)
        near = d[np.arange(len(part)), home]
        row, anchor = np.nonzero(d <= near[:, None] + np.uint8(bits))
        yield anchor, part[row], anchor == home[row]


def crowds(fps: DataFrame, k: int, bits: int) -> np.ndarray:
    """For each anchor its number of homes, and of all copies: two rows of 2^k numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << k), np.int64)
        for batch in batches:
            for anchor, _, home in copies(batch.column(0).to_numpy().view(np.uint64), k, bits):
                n += np.bincount(anchor[home], minlength=1 << k), np.bincount(anchor, minlength=1 << k)
        at = np.flatnonzero(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0][at]), pa.array(n[1][at])], names=["anchor", "homes", "all"])

    found = fps.select("fp").mapInArrow(run, "anchor int, homes long, all long").groupBy("anchor").agg(F.sum("homes").alias("homes"), F.sum("all").alias("all")).toArrow()
    out = np.zeros((2, 1 << k), np.int64)
    out[:, found["anchor"].to_numpy()] = found["homes"].to_numpy(), found["all"].to_numpy()
    return out


def _dealt(fps: np.ndarray, tiles: np.ndarray, salt: int) -> np.ndarray:
    """Which of its anchor's tiles each fingerprint goes to."""
    return ((fps ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles


def _for_each(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places 0, 1, 2, ... as often as times says, and the running number within each."""
    place = np.repeat(np.arange(len(times)), times)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)


def tiles(fps: DataFrame, k: int, bits: int, tile: int, pack: int = 1 << 14) -> DataFrame:
    """(anchor, i, j, homes, guests): packed stretches of fingerprints. Tile i, j of an anchor compares its i-th share of homes with its j-th of all copies.

    A row holds what some ten thousand fingerprints send to one tile, so rows
    are few and a home that several tiles need is a number in an array.
    """
    spark = fps.sparkSession
    homes, every = crowds(fps, k, bits)
    sizes = spark.sparkContext.broadcast((-(-homes // tile), np.maximum(1, -(-every // (WIDE * tile)))))

    def packed(own: np.ndarray) -> pa.RecordBatch:
        rows, columns = sizes.value
        parts = []
        for anchor, fp, home in copies(own, k, bits):
            at, j = _for_each(columns[anchor[home]])
            a, x = anchor[home][at], fp[home][at]
            parts.append((a, _dealt(x, rows[a], 0), j, np.zeros(len(a), np.int64), x))
            at, i = _for_each(rows[anchor])
            a, x = anchor[at], fp[at]
            parts.append((a, i, _dealt(x, columns[a], 1), np.ones(len(a), np.int64), x))
        a, i, j, guest, x = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((guest, j, i, a))
        a, i, j, guest, x = (c[order] for c in (a, i, j, guest, x))
        new = np.flatnonzero(np.diff(a, prepend=-1) | np.diff(i, prepend=-1) | np.diff(j, prepend=-1))
        ends = np.append(new, len(a))
        # Within a row's stretch the homes come first.
        split = ends[:-1] + np.add.reduceat((guest == 0).astype(np.int64), new) if len(new) else new
        ids = pa.array(x.view(np.int64))
        bounds = np.empty(2 * len(new) + 1, np.int32)
        bounds[0::2], bounds[1::2] = ends, split
        both = pa.ListArray.from_arrays(pa.array(bounds), ids)
        columns_ = [both.take(pa.array(np.arange(s, 2 * len(new), 2))) for s in (0, 1)]
        return pa.RecordBatch.from_arrays([*(pa.array(c[new].astype(np.int32)) for c in (a, i, j)), *columns_], names=["anchor", "i", "j", "homes", "guests"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= pack:
                yield packed(np.concatenate(held))
                held = []
        if held:
            yield packed(np.concatenate(held))

    return fps.select("fp").mapInArrow(run, "anchor int, i int, j int, homes array<long>, guests array<long>")


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a, b: each node's is the smallest node of its component."""
    a, b = label[a], label[b]
    a, b = a[a != b], b[a != b]
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(next_ := label[label], label):
            label = next_
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def tile_links(homes: np.ndarray, guests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sets of fingerprints, as (node, root). Holds the pairs of 128 homes at a time."""
    nodes, back = np.unique(np.concatenate([homes, guests]), return_inverse=True)
    h, g = back[: len(homes)], back[len(homes) :]
    label = np.arange(len(nodes))
    for at in range(0, len(homes), 128):
        i, j = np.nonzero(np.bitwise_count(homes[at : at + 128, None] ^ guests[None, :]) <= bits)
        label = merged(label, h[at + i], g[j])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """(a, b) over distinct fingerprints (column fp): connects exactly those that chains of near pairs connect."""
    placed = tiles(fps, code_size(fps.count()), bits, tile)

    def compare(t: pa.Table) -> pa.Table:
        homes, guests = (t[c].combine_chunks().flatten().to_numpy().view(np.uint64) for c in ("homes", "guests"))
        a, b = tile_links(homes, guests, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return placed.groupBy("anchor", "i", "j").applyInArrow(compare, "a long, b long")


def tile_neighbours(homes: np.ndarray, guests: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(a, b, apart, place): for each fingerprint a of a tile, of the other side's within bits and not equal, the nearest and that with the first place by a hash.

    Holds the pairs of 128 homes at a time.
    """
    nodes, back = np.unique(np.concatenate([homes, guests]), return_inverse=True)
    h, g = back[: len(homes)], back[len(homes) :]
    place = (nodes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).view(np.int64)
    by_place = np.argsort(place, kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[by_place] = np.arange(len(nodes))
    best = np.full((2, len(nodes)), 1 << 62)
    for at in range(0, len(homes), 128):
        apart = np.bitwise_count(homes[at : at + 128, None] ^ guests[None, :])
        i, j = np.nonzero((apart <= bits) & (apart > 0))
        x, y, d = h[at + i], g[j], apart[i, j].astype(np.int64) << 32
        for a, b in ((x, y), (y, x)):
            np.minimum.at(best[0], a, d | rank[b])
            np.minimum.at(best[1], a, rank[b])
    a = np.flatnonzero(best[1] < 1 << 62)
    b = by_place[best[:, a] & 0xFFFFFFFF].ravel()
    a = np.tile(a, 2)
    return nodes[a], nodes[b], np.bitwise_count(nodes[a] ^ nodes[b]).astype(np.int32), place[b]


def neighbours(fps: DataFrame, bits: int, reach: int = BITS, tile: int = TILE) -> DataFrame:
    """(a, b) over distinct fingerprints (column fp): each with the nearest other within bits, and with that of all met within bits which a hash puts first.

    Fingerprints go to anchors within their own distance plus reach, so pairs
    at most reach apart all meet, and wider ones where they share an anchor.
    Two pairs for each at most: a family is joined as a star about the one that
    the hash puts first, not by all its pairs.
    """
    placed = tiles(fps, code_size(fps.count()), reach, tile)

    def compare(t: pa.Table) -> pa.Table:
        homes, guests = (t[c].combine_chunks().flatten().to_numpy().view(np.uint64) for c in ("homes", "guests"))
        a, b, apart, place = tile_neighbours(homes, guests, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64), "apart": apart, "place": place})

    met = placed.groupBy("anchor", "i", "j").applyInArrow(compare, "a long, b long, apart int, place long")
    two = met.groupBy("a").agg(F.min_by("b", F.struct("apart", "place", "b")).alias("nearest"), F.min_by("b", F.struct("place", "b")).alias("first"))
    return two.select("a", F.explode(F.array_distinct(F.array("nearest", "first"))).alias("b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row."""
    rows = staged(fingerprints(docs, words), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = staged(distinct, "simhash-distinct")
    found = connected_components(links(distinct, bits))
    classes = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "component_id")
    hexadecimal = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp").select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of docs, as it is, of each component: that with the smallest doc_id, of its rows the first."""
    rows, key = numbered(docs, "_simhash_row")
    whole = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.col(key).alias("row"))
    found = near_duplicates(rows.select(whole.alias("doc_id"), "text"), words, bits)
    return kept_rows(rows, key, found.select("component_id.row").distinct())


def kept_rows(rows: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows whose number, under key, is among those of kept's one column; without the number."""
    name = free_name(rows, "_kept_row")
    kept = kept.toDF(name)
    return rows.join(kept.hint("shuffle_hash"), F.col(key) == F.col(name), "left_semi").drop(key)
