"""Operator 5: a content-addressed store of token ids.

Rolling hashes over the last 16 ids cut every document's id stream into
chunks where the content says so; equal chunks are stored once, under their
digest; a recipe lists each document's chunks; a Merkle tree over the recipes
proves the whole. Files, all Parquet, below one folder:

``packs``     a row for each use of a chunk (doc row, place, digest); exactly
              one row of each digest carries the ids themselves, little-endian
              in the narrowest width the vocabulary allows
``recipes``   a row per document in ascending doc_id order: digests, lengths,
              number of ids before it, its Merkle leaf
``manifest``  the tree above the leaves, 1,024 children a node
``about``     one row: bytes of an id, fan-out, number of documents

Reading starts with the tree: leaves are made anew of the recipes and the nodes
above of them, and every node must be the manifest's. With each chunk checked
against its digest, and its length against the recipes, that verifies what is
put together.

Cutting, digests and lengths are decided in the encoding pass. Payloads are
shuffled once, by digest, after every task has dropped its own repeats, so a
chunk that a third of all documents share reaches its partition once per task.

Defined cases: null text has the end id alone; repeated rows are documents of
their own, in the order of their content; null doc_ids come first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions.running import range_numbered, running_total
from geoweft.llm.common import shuffle_partitions, text_slices
from geoweft.llm.tokens import encoder

WINDOW, SHORTEST, LONGEST = 16, 64, 4096
FANOUT = 1024


def cut_points(ids: np.ndarray, starts: np.ndarray, mean_bits: int = 9) -> list[list[int]]:
    """For id streams laid end to end: the ends of the chunks of each, relative to its start.

    A chunk ends where the hash of the last WINDOW ids has mean_bits zero bits,
    is never shorter than SHORTEST (so no window reaches over a start), and
    never longer than LONGEST.
    """
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint64(step)
        h = h + shifted
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(h >> np.uint64(64 - mean_bits) == 0) + 1
    out = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        ends, last = [], lo
        for x in at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi)].tolist():
            while x - last > LONGEST:
                last += LONGEST
                ends.append(last - lo)
            if x - last >= SHORTEST:
                ends.append(x - lo)
                last = x
        while hi - last > LONGEST:
            last += LONGEST
            ends.append(last - lo)
        out.append([*ends, hi - lo] if hi > last else ends)
    return out


PACK = "row long, doc_id {kind}, pos int, digest binary, n int, stop int, payload binary"


def _cutter(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), set()
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for part in text_slices(batches, text=2):
            streams = [x + end for x in enc.encode([x or "" for x in part.column(2).to_pylist()])]
            starts = np.cumsum([0, *map(len, streams)]) // enc.dtype.itemsize
            cuts = cut_points(np.frombuffer(b"".join(streams), enc.dtype), starts)
            own, pos, digests, n, stops, payloads = [], [], [], [], [], []
            width = enc.dtype.itemsize
            for i, (stream, ends) in enumerate(zip(streams, cuts)):
                last = 0
                for p, x in enumerate(ends):
                    chunk = stream[last * width : x * width]
                    digest = hashlib.blake2b(chunk, digest_size=16).digest()
                    own.append(i)
                    pos.append(p)
                    n.append(x - last)
                    stops.append(x)
                    digests.append(digest)
                    payloads.append(None if digest in seen else chunk)
                    if len(seen) < 200_000:
                        seen.add(digest)
                    last = x
            take = pa.array(own, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), pa.array(pos, pa.int32()), pa.array(digests, pa.binary()), pa.array(n, pa.int32()), pa.array(stops, pa.int32()), pa.array(payloads, pa.binary())],
                names=["row", "doc_id", "pos", "digest", "n", "stop", "payload"],
            )

    return run


def _elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves the ids of a digest in the first of its rows in this partition, which gets all that carry any."""
    seen: set[bytes] = set()
    for batch in batches:
        payloads = batch.column(6).to_pylist()
        for i, digest in enumerate(batch.column(3).to_pylist()):
            if payloads[i] is not None:
                if digest in seen:
                    payloads[i] = None
                seen.add(digest)
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(payloads, pa.binary())], names=batch.schema.names)


def write_store(docs: DataFrame, out: str, path: str, end_id: int = 1) -> None:
    """Encodes whole texts, appends end_id to each, and writes the store below ``out``."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    n = shuffle_partitions(spark)
    pack = PACK.format(kind=kind)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_cutter(path, end_id), pack)
    # Rows with ids meet by digest; rows without go wherever there is room.
    route = F.when(F.col("payload").isNotNull(), F.xxhash64("digest")).otherwise(F.xxhash64("row", "pos"))
    rows.repartition(n, route).mapInArrow(_elect, pack).write.option("compression", "zstd").parquet(f"{out}/packs")

    uses = spark.read.parquet(f"{out}/packs").select("row", "doc_id", "pos", "digest", "n", "stop")
    recipes = uses.groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("pos", "digest", "n", "stop"))).alias("chunks"))
    recipes = recipes.withColumn("leaf", leaf_of()).persist()
    try:
        order = ["doc_id", "leaf", "row"]
        light = range_numbered(recipes.select(*order, "n_tokens", F.lit(1).alias("one")), order, n, "bucket", "token-store-order")
        placed = running_total(light, "n_tokens", order, "bucket", "start")
        placed = running_total(placed, "one", order, "bucket", "rank").select("row", "start", "rank")
        done = recipes.select("row", "doc_id", "n_tokens", "chunks", "leaf").join(placed, "row")
        done.orderBy("rank").write.parquet(f"{out}/recipes")
    finally:
        recipes.unpersist()

    nodes = merkle_levels(_leaves(spark, out))
    nodes.write.parquet(f"{out}/manifest")
    about = spark.read.parquet(f"{out}/recipes").agg(F.lit(encoder(path).dtype.itemsize).alias("width"), F.lit(FANOUT).alias("fanout"), F.count("*").alias("documents"))
    about.coalesce(1).write.parquet(f"{out}/about")


def leaf_of() -> Column:
    """A document's leaf: digests, lengths and ends of its chunks in order, and its number of ids."""
    parts = F.transform("chunks", lambda x: F.concat_ws(":", F.hex(x["digest"]), x["n"].cast("string"), x["stop"].cast("string")))
    return F.sha2(F.concat_ws(",", F.array_join(parts, ","), F.col("n_tokens").cast("string")), 256)


def _leaves(spark: SparkSession, out: str) -> DataFrame:
    """(level, place, node) of the leaves, made of the recipes and where they say they lie."""
    node = F.sha2(F.concat_ws(":", leaf_of(), F.col("start").cast("string"), F.col("doc_id").cast("string")), 256)
    return spark.read.parquet(f"{out}/recipes").select(F.lit(0).alias("level"), F.col("rank").alias("place"), node.alias("node"))


def merkle_levels(leaves: DataFrame) -> DataFrame:
    """All nodes above the leaves (level, place, node); the last level has one."""
    out, level, count = None, leaves, leaves.count()
    k = 0
    while k == 0 or count > 1:
        k += 1
        level = level.groupBy((F.col("place") / FANOUT).cast("long").alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("below"))
        level = level.select(F.lit(k).alias("level"), "place", F.sha2(F.concat_ws("", F.col("below.node")), 256).alias("node"))
        out = level if out is None else out.unionByName(level)
        count = -(-count // FANOUT)
    return out


def verify_manifest(spark: SparkSession, out: str) -> bool:
    """Makes the tree anew from the recipes and compares every node."""
    there, made = spark.read.parquet(f"{out}/manifest"), merkle_levels(_leaves(spark, out))
    other = made.select(F.col("level").alias("l"), F.col("place").alias("p"), F.col("node").alias("made"))
    differ = there.join(other, (F.col("level") == F.col("l")) & (F.col("place") == F.col("p")), "full_outer").where(~F.col("node").eqNullSafe(F.col("made")))
    return differ.isEmpty()


def _verified(spark: SparkSession, out: str) -> int:
    """Bytes of an id, for a store whose recipes are those of its manifest."""
    if not verify_manifest(spark, out):
        raise ValueError(f"the recipes of {out} aren't those of its manifest")
    return spark.read.parquet(f"{out}/about").first().width


def _chunks_read(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if hashlib.blake2b(payload, digest_size=16).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} doesn't have the ids of its digest")
                ids = np.frombuffer(payload, f"<u{width}")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "n_read", "crc"])

    return run


def _zero_tables() -> list[np.ndarray]:
    """For each power of two of zero bytes: what appending them does to each byte of a CRC-32."""
    base = np.array([[zlib.crc32(b"\0", v << (8 * k)) ^ zlib.crc32(b"\0", 0) for v in range(256)] for k in range(4)], np.uint32)
    tables = [base]
    for _ in range(40):
        t = tables[-1]
        tables.append(np.stack([_through(t, t[k]) for k in range(4)]))
    return tables


def _through(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]


def crc_moved(crc: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """The part that a CRC-32 keeps in that of a longer text, zero_bytes before its end.

    The CRC of a text is the exclusive or of its parts' CRCs, each so moved.
    """
    crc, left = crc.astype(np.uint32), zero_bytes.astype(np.int64)
    for table in _zero_tables():
        if not left.any():
            break
        crc = np.where(left & 1, _through(table, crc), crc)
        left = left >> 1
    return crc


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = crc_moved(batch.column(2).to_numpy(), 4 * batch.column(3).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc.astype(np.int64))], names=["row", "n_read", "crc"])


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: recipes are checked against the manifest, every
    chunk is read, checked against its digest and its ids summed up; the documents' sums follow from their recipes."""
    width = _verified(spark, out)
    packs = spark.read.parquet(f"{out}/packs")
    chunks = packs.where("payload is not null").select("digest", "payload").mapInArrow(_chunks_read(width), "digest binary, n_read long, crc long")
    recipes = spark.read.parquet(f"{out}/recipes")
    uses = recipes.select("row", "n_tokens", F.explode("chunks").alias("x"))
    uses = uses.select("row", F.col("x.digest").alias("digest"), F.col("x.n").alias("n"), (F.col("n_tokens") - F.col("x.stop")).alias("behind"))
    uses = uses.join(chunks, "digest", "left")  # a chunk that isn't there, or is of another length, fails the job
    whole = F.when(F.col("n_read").eqNullSafe(F.col("n")), F.col("n_read")).otherwise(F.raise_error(F.lit("a recipe's chunk is missing or of another length")))
    parts = uses.select("row", whole.cast("long").alias("n_read"), "crc", "behind").mapInArrow(_moved, "row long, n_read long, crc long")
    sums = parts.groupBy("row").agg(F.sum("n_read").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return recipes.select("row", "doc_id", "start").join(sums, "row").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, ids: array<int>): every document put together again from its recipe, which is checked against the manifest."""
    width = _verified(spark, out)
    packs = spark.read.parquet(f"{out}/packs").where("payload is not null").select("digest", "payload")
    recipes = spark.read.parquet(f"{out}/recipes")
    uses = recipes.select("row", "doc_id", "start", F.posexplode("chunks").alias("i", "x")).select("row", "doc_id", "start", "i", F.col("x.digest").alias("digest"))
    rows = uses.join(packs, "digest").groupBy("row", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("i", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in x), f"<u{width}").astype(np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "parts").mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")
