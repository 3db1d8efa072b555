"""Operator 1: byte-pair encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of every new word. A proposal is the
byte-pair result exactly if each adjacent pair of its tokens is what merging
would leave standing, so all adjacent pairs of a batch are tested together,
vectorised, by undoing merges on both sides of the joint from the latest to
the earliest and looking for a merge across it that would have come sooner.
Words with a failing pair, and only they, are merged exactly.

Defined cases: null text encodes as the empty text (no ids, decoded text
empty); strings of special tokens inside a text become their ids, as the
library has it; rows repeat as they come; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import text_slices
from geoweft.llm.tokens import SegmentEncoder, byte_letters

class SpeculativeBpe(SegmentEncoder):
    """Encodes and decodes with a tokenizers JSON file; merging is done here, not by the library."""

    def _ready(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.letter = byte_letters()
        self.to_letters = {b: x for b, x in enumerate(self.letter)}
        self.byte_of = {x: b for b, x in enumerate(self.letter)}

        tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for x, i in (self.vocab | self.special).items():
            tokens[i] = x
        self.tokens = tokens
        self.joined_by_space = spec.get("decoder") is None
        self.token_bytes = [x.encode() for x in tokens] if self.joined_by_space else [bytes(self.byte_of[c] for c in x) if i not in self.special.values() else x.encode() for i, x in enumerate(tokens)]

        self.size = size = len(tokens)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        born = np.full(size, -1, np.int64)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys, ranks = np.empty(len(merges), np.int64), np.arange(len(merges), dtype=np.int64)
        for n, (a, b) in enumerate(merges):
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), (n, made))
            keys[n] = x * size + y
            if born[made] < 0:
                born[made], left[made], right[made] = n, x, y
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.born, self.left, self.right = born, left, right
        # A token that merging its own letters doesn't give back is never proposed.
        self.proposable = {x for x, i in self.vocab.items() if self.merged(self.letters(x)) == [i]}
        self.widest = max(map(len, self.proposable))

    def letters(self, word: str) -> list[int] | None:
        """Ids of the single letters of a word, the last with the end-of-word mark."""
        if self.suffix and word.endswith(self.suffix):
            body = word[: -len(self.suffix)]
            parts = [*body[:-1], body[-1:] + self.suffix]
        else:
            parts = list(word)
        return [self.vocab[x] for x in parts] if all(x in self.vocab for x in parts) else None

    def merged(self, ids: list[int] | None) -> list[int] | None:
        """Exact merging: the earliest merge first, of equal ones the leftmost."""
        if ids is None or len(ids) < 2:
            return ids
        rank, n = self.rank, len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if r := rank.get((made, ids[after[j]])):
                    heapq.heappush(heap, (r[0], i, made, ids[after[j]], r[1]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], made))):
                heapq.heappush(heap, (r[0], h, ids[h], made, r[1]))
        return [x for x in ids if x >= 0]

    def proposed(self, word: str) -> list[int] | None:
        """Longest match from the left; None where a letter has no token."""
        out, at, end, ok, vocab, suffix = [], 0, len(word), self.proposable, self.vocab, self.suffix
        while at < end:
            if end - at <= self.widest and (x := word[at:] + suffix) in ok:
                out.append(vocab[x])
                break
            for to in range(min(end - bool(suffix), at + self.widest), at, -1):
                if (x := word[at:to]) in ok:
                    out.append(vocab[x])
                    at = to
                    break
            else:
                return None
        return out

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For arrays of token pairs: does merging the letters of both leave just this pair?

        limit: rank of the merge that next swallows a token at the joint. The
        leftmost of equal merges goes first, so a merge across the joint also
        beats an equal one inside the right token (hence twice the rank, plus one).
        """
        x, y = one.copy(), two.copy()
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), np.iinfo(np.int64).max)
        while len(open_):
            a, b = x[open_], y[open_]
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, 2 * self.pair_ranks[at], np.iinfo(np.int64).max)
            bad = across < limit[open_]
            good[open_[bad]] = False
            open_, a, b = open_[~bad], a[~bad], b[~bad]
            ra, rb = self.born[a], self.born[b]
            whole = (ra >= 0) | (rb >= 0)
            open_, a, b, ra, rb = open_[whole], a[whole], b[whole], ra[whole], rb[whole]
            undo_right = rb >= ra
            limit[open_] = np.where(undo_right, 2 * rb + 1, 2 * ra)
            y[open_[undo_right]] = self.left[b[undo_right]]
            x[open_[~undo_right]] = self.right[a[~undo_right]]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        spelt = ["".join(map(self.letter.__getitem__, x.encode())) for x in words]
        ids = [self.proposed(x) for x in spelt]
        flat = np.array([i for x in ids if x for i in x], np.int64)
        owner = np.repeat(np.arange(len(ids)), [len(x or ()) for x in ids])
        joint = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[joint] * self.size + flat[joint + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[back]
        for n in {*owner[joint[~fine]].tolist(), *(n for n, x in enumerate(ids) if x is None)}:
            ids[n] = self.merged(self.letters(spelt[n] + self.suffix)) or []
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8, special tokens kept."""
        parts = map(self.token_bytes.__getitem__, ids.tolist())
        return b" ".join(parts) if self.joined_by_space else b"".join(parts).decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def speculative_bpe(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = speculative_bpe(path)
        for part in text_slices(batches):
            rows = [np.frombuffer(x, bpe.dtype).astype(np.int32) for x in bpe.encode(_texts(part))]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(rows))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) from (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = speculative_bpe(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text and decodes the ids again.

    Encoding and decoding share one pass here so that the ids, larger than the
    text, never leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = speculative_bpe(path)
        for part in text_slices(batches):
            n, ids_sha, text_sha = [], [], []
            for x in bpe.encode(_texts(part)):
                ids = np.frombuffer(x, bpe.dtype)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4")).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(1).to_pylist()]
