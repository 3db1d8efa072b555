"""Near-duplicates by SimHash and exact similarity: all pairs of shingle sets with a Jaccard similarity of LEAST or more, none lost.

The pipeline's near-dedup stage: five words a shingle, a similarity of 0.8 or
more. Every set has a SimHash of its shingles, and operator 6's anchor covering
finds each one's neighbours. Sets 0.8 alike differ in about ten of 64 bits;
anchors that hold every pair so far apart would hold most fingerprints. So
copies go as far as operator 6 sends them, REACH bits beyond their home, which
holds all pairs at most REACH apart for certain, and where two meet they count
as candidates up to APART bits. Candidates get their exact similarity, and
components are formed of the pairs that have it.

What SimHash can't promise, the pairs that differ in more bits or meet at no
anchor, has an exact way: a prefix filter, for pairs across those components
only. Shingles have an order, the rare ones first; of two sets at least LEAST
alike, the first n - ceil(LEAST n) + 1 shingles of each share one. So sets meet
by an equi-join on those shingles, under the length and position bounds. Any
order is right; how rare a shingle is comes from one row of a count sketch of
BUCKETS counters, which is all that reaches the driver.

A family of many near copies isn't paired with itself. SimHash gives each set
its nearest neighbour and one that its family agrees on. Then each set is
compared with one set of each shingle that it shares, of another component,
which joins most that is left of a family; then only sets that share a shingle
but are in different components so far. Any pair left out is in one component
already.

Equal sets are one before any of this.

Defined cases: as operator 6 has them. Texts without a word are alike; a text
shorter than a shingle is one shingle. Shingles and sets go by 64-bit hashes;
a set's SimHash is of its distinct shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm import simhash
from geoweft.llm.common import looked_up, numbered, shuffle_partitions, staged, temporary, text_slices
from geoweft.llm.simhash import kept_rows
from geoweft.operators.components import connected_components, with_edges
from geoweft.session import counted, gathered

WORDS, LEAST = 5, 0.8
#: Bits that SimHash candidates differ in at most, and bits beyond their home's that fingerprints are copied to anchors.
APART, REACH = 12, simhash.BITS
BUCKETS = 1 << 17
MANY = 200
#: Rows of a partition where tables are small: prefixes, and pairs with texts.
EACH, TEXTS = 20_000, 1_000


class WordHashes(dict):
    """64-bit hashes of the words met so far, up to MOST of them."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 3)
        return found


WORD_HASHES = WordHashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles as 64-bit hashes, in order: of a shingle's words and their order."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(WORD_HASHES.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    mixed = np.full(max(0, len(found) - size + 1) if size else 0, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ h[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.sort(mixed ^ (mixed >> np.uint64(32)))
    return mixed[np.append(True, mixed[1:] != mixed[:-1])[: len(mixed)]]


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


def set_ids(docs: DataFrame, words: int) -> DataFrame:
    """(doc, id, fp): id is that of the text's shingle set, fp the set's SimHash, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [shingle_set(x, words) for x in part.column(1).to_pylist()]
            ids, fps = (np.fromiter(map(f, sets), np.uint64, len(sets)).view(np.int64) for f in (set_id, simhash.majority))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids), pa.array(fps)], names=["doc", "id", "fp"])

    return docs.select("doc", "text").mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, id long, fp long")


def simhash_pairs(ids: DataFrame, apart: int = APART, reach: int = REACH) -> DataFrame:
    """(a, b), a < b: candidates among the set ids (columns id, fp) by operator 6's anchor covering. Sets of one fingerprint go with the least of them."""
    sets, n = counted(ids.groupBy("id").agg(F.min("fp").alias("fp")), "near-sets")
    classes = staged(gathered(sets.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("times")), n, EACH), "near-fingerprints")
    equal = looked_up(sets, classes.where("times > 1"), ["fp"], "times", n).select(F.col("id").alias("a"), F.col("least").alias("b"))
    met, m = counted(simhash.neighbours(classes.select("fp"), apart, reach), "near-met")
    least = classes.select("fp", "least")
    uses = met.groupBy("b").agg(F.count("*").alias("times")).join(least.select(F.col("fp").alias("b"), F.col("least").alias("second")), "b")
    own = met.join(least.select(F.col("fp").alias("a"), F.col("least").alias("first")), "a")
    pairs = looked_up(own, uses, ["b"], "times", m).select("first", "second").toDF("a", "b").unionByName(equal)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def bucket_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many texts have a shingle in each bucket, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for part in text_slices(batches, text=0):
            for x in part.column(0).to_pylist():
                np.add.at(counts, (shingle_set(x, words) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefix_size(n: int, least: float) -> int:
    """Sets of n, least alike or more, share one of so many first shingles. Rounding errs to one more."""
    return n - int(np.ceil(least * n - 1e-9)) + 1


def prefixes(docs: DataFrame, words: int, least: float) -> DataFrame:
    """(token, id, at, n): the first shingles of each text's set of n, rare ones first."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text=0):
            rows: list[tuple[np.ndarray, ...]] = []
            for x in part.column(0).to_pylist():
                own = shingle_set(x, words)
                if not len(own):
                    continue
                order = np.lexsort((own, counts.value[(own % np.uint64(BUCKETS)).astype(np.int64)]))
                first = own[order[: prefix_size(len(own), least)]]
                rows.append((first, np.full(len(first), set_id(own), np.uint64), np.arange(len(first), dtype=np.int32), np.full(len(first), len(own), np.int32)))
            if rows:
                token, ids, at, n = (np.concatenate(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ids.view(np.int64)), pa.array(at), pa.array(n)], names=["token", "id", "at", "n"])

    return docs.select("text").mapInArrow(run, "token long, id long, at int, n int")


def shared_prefixes(docs: DataFrame, words: int, least: float) -> DataFrame:
    """(token, id, at, n): the first shingles that two sets or more have among theirs, each once.

    Most first shingles are their text's own. Rows are shuffled by token once,
    and only those that share it are stored.
    """
    by_token = Window.partitionBy("token")
    rows = prefixes(docs, words, least).repartition(shuffle_partitions(docs.sparkSession), "token")
    rows = rows.withColumn("before", F.lag("id").over(by_token.orderBy("id"))).withColumn("alone", F.min("id").over(by_token) == F.max("id").over(by_token))
    return staged(rows.where("not alone and not (before <=> id)").drop("before", "alone"), "near-shared")


def _possible(least: float) -> Column:
    """The length and position bounds of a pair at, n and at2, n2."""
    need = F.lit(least / (1 + least)) * (F.col("n") + F.col("n2")) - 1e-6
    return F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= need


def in_components(shared: DataFrame, found: DataFrame | None, rows: int = 1 << 62) -> DataFrame:
    """shared, of so many rows, with the component c of each set so far (found: node, component), without the shingles whose sets are in one."""
    if found is None:
        return shared.withColumn("c", F.col("id"))
    placed = shared.join(found, F.col("id") == F.col("node"), "left").select("token", "id", "at", "n", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    return staged(gathered(placed.join(mixed.hint("shuffle_hash"), "token", "left_semi"), rows, EACH), "near-open")


def star_pairs(placed: DataFrame, least: float) -> DataFrame:
    """(a, b): each set with the one that leads a shingle of it: that which has the most company over all its shingles."""
    sizes = placed.groupBy("token").agg(F.count("*").alias("size"))
    company = placed.join(sizes, "token").groupBy("id").agg(F.sum("size").alias("company"))
    leader = F.max(F.struct("company", F.col("id").alias("b"), F.col("at").alias("at2"), F.col("n").alias("n2"), F.col("c").alias("c2"))).alias("l")
    leaders = placed.join(company, "id").groupBy("token").agg(leader).select("token", "l.b", "l.at2", "l.n2", "l.c2")
    return placed.join(leaders, "token").where("c <> c2").where(_possible(least)).select(F.col("id").alias("a"), "b").distinct()


def open_pairs(placed: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: the sets that share a shingle and aren't in one component."""
    other = placed.select("token", F.col("id").alias("b"), F.col("at").alias("at2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    return placed.join(other.hint("shuffle_hash"), "token").where("id < b and c <> c2").where(_possible(least)).select(F.col("id").alias("a"), "b").distinct()


def with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, side: str) -> DataFrame:
    """rows, which are pairs and more, with text_<side>. A text that very many pairs need is copied for each MANY of them, so they spread."""
    times = pairs.groupBy(side).agg(F.ceil(F.count("*") / MANY).cast("int").alias("times"))
    copies = times.join(texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)
    copies = copies.select(side, f"text_{side}", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("salt"))
    salted = pairs.join(times, side).select("a", "b", F.pmod(F.xxhash64("a", "b"), F.col("times")).cast("int").alias("salt"))
    salted = salted.join(copies.hint("shuffle_hash"), [side, "salt"]).drop("salt")
    return salted if rows is pairs else rows.join(salted, ["a", "b"])


def alike_pairs(pairs: DataFrame, shared: int, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those pairs (a, b) of set ids that have a similarity of least or more. texts: id, text; shared: rows of the prefixes that the pairs come from."""
    pairs, n = counted(gathered(pairs, shared, EACH), "near-candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = staged(gathered(texts.join(wanted.hint("shuffle_hash"), "id", "left_semi"), 2 * n, TEXTS), "near-pair-texts", compression="zstd")
    both = with_text(with_text(pairs, pairs, texts, "a"), pairs, texts, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in text_slices(iter([whole]), text=2):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    p, q = shingle_set(x, words), shingle_set(y, words)
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(common >= least * (len(p) + len(q) - common) - 1e-9)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return gathered(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), n, TEXTS)


def alike(docs: DataFrame, ids: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(node, component) of the set ids that have a similarity of least or more to another. docs has doc and text, ids what set_ids makes of it."""
    with temporary(docs.sparkSession):
        close, n = counted(simhash_pairs(ids), "near-close")
        shared = shared_prefixes(docs, words, least)
        rows = shared.count()
        needed = close.select(F.explode(F.array("a", "b")).alias("id")).unionByName(shared.select("id")).distinct()
        wanted = ids.groupBy("id").agg(F.min("doc.row").alias("row")).join(needed, "id", "left_semi")
        texts = docs.select(F.col("doc.row").alias("row"), "text").join(wanted.hint("shuffle_hash"), "row").select("id", "text")
        texts = staged(texts, "near-texts", compression="zstd")
        found = staged(connected_components(alike_pairs(close, n, texts, words, least)), "near-simhash")
        for across in (star_pairs, open_pairs):
            near = alike_pairs(across(in_components(shared, found, rows), least), rows, texts, words, least)
            found = staged(with_edges(found, near), f"near-{across.__name__}", keep=across is open_pairs)
        return found


def representatives(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of docs, as it is, of each component: that with the smallest doc_id, of its rows the first."""
    rows, key = numbered(docs, "_near_row")
    whole = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.col(key).alias("row"))
    texts = rows.select(whole.alias("doc"), "text")
    ids = staged(set_ids(texts, words), "near-ids")
    found = alike(texts, ids, words, least)
    classes = ids.groupBy("id").agg(F.min("doc").alias("doc")).join(found, F.col("id") == F.col("node"), "left")
    first = classes.groupBy(F.coalesce("component", "id")).agg(F.min("doc").alias("doc")).select("doc.row")
    return kept_rows(rows, key, first)
