"""Operator 4: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens, its documents in doc_id order. A window of
``window`` sequences takes from every queue its target share; what a share
loses to rounding is a deficit that the next window pays back. Windows are
gathered in blocks of a fixed token count. Where block b of a queue of N
tokens begins, floor(b * N / blocks), is the deficit round-robin state in
closed form: the deficit carried into a block is the fraction dropped there.
So all blocks, on any number of machines, run at once and still continue each
other, and every queue empties exactly at the end of the last block.

The target is the corpus mixture, or ``weights`` by source. With weights the
schedule has phases: a source that runs dry leaves its share to the others.

Documents may be cut anywhere. Where a block begins in the packed stream of
all blocks is a running total over blocks, so sequences are cut at the same
1,024 places of that stream whatever the blocks, also across them. Only what is
left at the very end is cut into powers of two, so that no sequence needs
padding.

Defined cases: null text is the end id alone; null source is a queue of its
own; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions.running import range_numbered, running_total
from geoweft.llm.common import shuffle_partitions, staged, text_slices
from geoweft.llm.tokens import encoder

SEQUENCE, WINDOW_SEQUENCES, BLOCK_WINDOWS = 1024, 32, 8


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(row, doc_id, source, doc_tokens, ids): ids little-endian, in the narrowest width, with the end id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for part in text_slices(batches, text=3):
            ids = [x + end for x in enc.encode([x or "" for x in part.column(3).to_pylist()])]
            n = pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], n, pa.array(ids, pa.binary())], names=["row", "doc_id", "source", "doc_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, source string, doc_tokens long, ids binary")


def shares(sizes: np.ndarray, window: int) -> list[np.ndarray]:
    """Deficit round-robin over queues of these sizes: tokens each window takes of each queue.

    A queue's credit grows by its share of a window and pays for whole tokens;
    places left over go to the largest credits, which then go into debt.
    """
    total = int(sizes.sum())
    left, credit, out = sizes.astype(np.int64).copy(), np.zeros(len(sizes)), []
    quantum = sizes / total * window if total else sizes
    while left.sum() > window:
        credit += quantum
        take = np.minimum(np.floor(np.maximum(credit, 0)).astype(np.int64), left)
        over = int(take.sum()) - window
        for s in np.argsort(credit - take, kind="stable") if over > 0 else ():
            back = min(over, int(take[s]))
            take[s] -= back
            over -= back
        while over < 0:
            order = [s for s in np.argsort(take - credit, kind="stable") if take[s] < left[s]]
            for s in order[: -over]:
                take[s] += 1
                over += 1
        credit -= take
        left -= take
        out.append(take)
    out.append(left)
    return out


def sequence_starts(total: int, low: int, high: int) -> tuple[int, np.ndarray]:
    """Of the sequences of a stream of total tokens: the number of that with token low, and the starts of it and all others before high."""
    full = total // SEQUENCE
    tail = [1 << b for b in range(SEQUENCE.bit_length() - 2, -1, -1) if total % SEQUENCE >> b & 1]
    ends = full * SEQUENCE + np.cumsum([0, *tail])[: len(tail)]
    starts = np.concatenate([np.arange(low // SEQUENCE, min(full, -(-high // SEQUENCE))) * SEQUENCE, ends[ends < high]]).astype(np.int64)
    first = max(0, int(np.searchsorted(starts, low, "right")) - 1)
    return int(starts[first]) // SEQUENCE + int(np.searchsorted(ends, starts[first])) if len(starts) else 0, starts[first:]


def pack_block(queue: np.ndarray, start: np.ndarray, length: np.ndarray, window: int, origin: int = 0, total: int | None = None) -> dict[str, np.ndarray]:
    """Packs one block, which begins at origin in a stream of total tokens. The rows are stretches of documents, by queue and place in it.

    Returns arrays over the pieces: stretch (row number), skip (tokens of it
    before the piece), length, sequence, offset.
    """
    names, q = np.unique(queue, return_inverse=True)
    order = np.lexsort((start, q))
    q, length = q[order], length[order]
    sizes = np.bincount(q, weights=length, minlength=len(names)).astype(np.int64)
    takes = np.array(shares(sizes, window), np.int64)  # window x queue
    # Tokens of the block by queue: where a stretch lies, and where a window's take lies.
    ends = np.cumsum(length)
    begins = ends - length
    base = np.cumsum(sizes) - sizes
    take_begin = (base + np.cumsum(takes, axis=0) - takes).ravel()
    flat = takes.ravel()
    place = np.cumsum(flat) - flat  # of a take in the packed stream
    some = flat > 0
    by_queue = np.argsort(take_begin[some], kind="stable")
    take_begin, place = take_begin[some][by_queue], place[some][by_queue]
    cuts = np.union1d(begins, take_begin)
    sizes_of = np.diff(np.append(cuts, ends[-1]))
    stretch = np.searchsorted(begins, cuts, "right") - 1
    take = np.searchsorted(take_begin, cuts, "right") - 1
    at = place[take] + cuts - take_begin[take]
    # Cut at the ends of sequences.
    at = at + origin
    stop = origin + int(ends[-1])
    number, bounds = sequence_starts(stop if total is None else total, origin, stop)
    first = np.searchsorted(bounds, at, "right") - 1
    last = np.searchsorted(bounds, at + sizes_of, "left") - 1
    n = last - first + 1
    item = np.repeat(np.arange(len(cuts)), n)
    sequence = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    lo = np.maximum(at[item], bounds[sequence])
    hi = np.minimum(at[item] + sizes_of[item], np.append(bounds, stop)[sequence + 1])
    skip = cuts[item] - begins[stretch[item]] + lo - at[item]
    return {"stretch": order[stretch[item]], "skip": skip, "length": hi - lo, "sequence": number + sequence, "offset": lo - bounds[sequence]}


def schedule(meta: DataFrame, weights: dict[str, float] | None, n: int, block_tokens: int) -> tuple[DataFrame, int]:
    """(block, queue, row, begin, length, skip): the stretch of each document in each block; and the number of all tokens.

    meta: row, doc_id, source, doc_tokens.
    """
    other = F.lit("*")
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    if weights is not None:
        named = F.when(F.col("source").isin(list(weights)), named).otherwise(other)
    meta = meta.withColumn("queue", named)
    meta = range_numbered(meta, ["doc_id", "row"], n, "bucket", "packing-order")
    placed = running_total(meta, "doc_tokens", ["doc_id", "row"], "bucket", "begin", by=["queue"])
    totals = meta.groupBy("queue").agg(F.sum("doc_tokens").alias("queue_tokens"))
    total = meta.agg(F.sum("doc_tokens")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    if weights is None:
        placed = placed.join(totals, "queue").withColumn("phases", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("queue_tokens").alias("to"), F.lit(0).cast("long").alias("first"), F.lit(blocks).cast("long").alias("count"))))
    else:
        plan = phases({r[0]: r[1] for r in totals.collect()}, weights, block_tokens)  # at most len(weights) + 1 rows
        kind = "queue string, phases array<struct<from:long,to:long,first:long,count:long>>"
        placed = placed.join(F.broadcast(meta.sparkSession.createDataFrame(plan, kind)), "queue")
    big = "decimal(38,0)"
    placed = placed.withColumn("p", F.explode("phases")).where("begin < p.to and begin + doc_tokens > p.from")
    placed = placed.selectExpr("row", "queue", "doc_tokens", "begin", "p.first as first", "p.count as count", "p.from as q0", "p.to - p.from as size", "greatest(begin, p.from) - p.from as lo", "least(begin + doc_tokens, p.to) - p.from as hi")
    block_at = f"cast(((cast({{x}} as {big}) + 1) * count - 1) div size as long)"
    placed = placed.selectExpr("*", f"explode(sequence({block_at.format(x='lo')}, {block_at.format(x='hi - 1')})) as b")
    edge = f"cast((cast({{b}} as {big}) * size) div count as long)"
    placed = placed.selectExpr("*", f"greatest(lo, {edge.format(b='b')}) as x", f"least(hi, {edge.format(b='b + 1')}) as y").where("x < y")
    return placed.selectExpr("first + b as block", "queue", "row", "q0 + x as begin", "y - x as length", "q0 + x - begin as skip"), total


def phases(totals: dict[str, int], weights: dict[str, float], block_tokens: int) -> list[tuple]:
    """Per queue its stretches of constant speed: (from, to, first block, blocks).

    Runs the shares until a queue is empty, then again without it. Queues
    without weight share what is left over, at the end.
    """
    left = dict(totals)
    weight = {"=" + k: float(v) for k, v in weights.items()}
    done, out, block = {q: 0 for q in totals}, {q: [] for q in totals}, 0
    while any(left.values()):
        live = {q: weight.get(q, 0.0) for q in left if left[q]}
        if not any(live.values()):
            live = {q: float(left[q]) for q in live}
        unit = min(left[q] / w for q, w in live.items() if w > 0)
        takes = {q: min(left[q], round(w * unit)) for q, w in live.items() if w > 0}
        takes = {q: t for q, t in takes.items() if t}
        count = max(1, -(-sum(takes.values()) // block_tokens))
        for q, t in takes.items():
            out[q].append((done[q], done[q] + t, block, count))
            done[q] += t
            left[q] -= t
        block += count
    return [(q, x) for q, x in out.items()]


def pack(docs: DataFrame, path: str, end_id: int = 0, weights: dict[str, float] | None = None, window_sequences: int = WINDOW_SEQUENCES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of a document."""
    pieces = pack_ids(docs, path, end_id, weights, window_sequences, block_windows)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_ids(docs: DataFrame, path: str, end_id: int, weights: dict[str, float] | None, window_sequences: int, block_windows: int, with_ids: bool = False) -> DataFrame:
    """As pack(); with_ids adds the ids of each piece (array<int>)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    n, window = shuffle_partitions(spark), window_sequences * SEQUENCE
    ids = staged(tokenized(docs, path, end_id), "packing-ids", compression="zstd")
    stretches, total = schedule(ids.select("row", "doc_id", "source", "doc_tokens"), weights, n, window * block_windows)
    stretches = staged(stretches, "packing-stretches")
    bases = stretches.groupBy("block").agg(F.sum("length").alias("tokens")).withColumn("bucket", (F.col("block") / 4096).cast("long"))
    bases = running_total(bases, "tokens", ["block"], "bucket", "base").select("block", "base")
    stretches = stretches.join(bases, "block")

    def block(t: pa.Table) -> pa.Table:
        got = pack_block(np.array(t["queue"].to_pylist(), object), t["begin"].to_numpy(), t["length"].to_numpy(), window, t["base"][0].as_py(), total)
        row, skip = t["row"].to_numpy()[got["stretch"]], t["skip"].to_numpy()[got["stretch"]]
        return pa.table({"row": row, "start": skip + got["skip"], "length": got["length"], "sequence_id": got["sequence"], "offset": got["offset"]})

    pieces = stretches.groupBy("block").applyInArrow(block, "row long, start long, length long, sequence_id long, offset long")
    pieces = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    width = encoder(path).dtype.itemsize

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = f"<u{width}"
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten()
            start, length = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            crc, own = [], []
            docs_ids = [np.frombuffer(x, dtype).astype("<u4") for x in batch.column(2).to_pylist()]
            for o, s, m in zip(owner.tolist(), start.tolist(), length.tolist()):
                x = docs_ids[o][s : s + m]
                crc.append(zlib.crc32(x))
                if with_ids:
                    own.append(x.astype(np.int32))
            take = pa.array(owner, pa.int32())
            columns = [batch.column(0).take(take), flat.field(0), flat.field(1), pa.array(crc, pa.int64()), batch.column(1).take(take), flat.field(2), flat.field(3)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(own, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = ids.join(pieces, "row").select("doc_id", "doc_tokens", "ids", "pieces")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return joined.mapInArrow(digest, schema + (", ids array<int>" if with_ids else ""))
