"""Operators 1, 4 and 5 against the tokenizers library and exact round trips."""

import hashlib
import random
import uuid
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoweft.llm import bpe, packing, token_store
from geoweft.llm.tokens import encoder
from geoweft.session import shared_dir

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def library(path):
    return Tokenizer.from_file(path)


def want(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


texts = st.lists(st.sampled_from(list("abcdethe  \n\t'srvé019!.,-ΣßİΣ中🙂́\x1c\x85") + ["<|endoftext|>", "   ", " \n ", "anthe"]), max_size=40).map("".join)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoders_equal_the_library(path):
    @settings(max_examples=300, deadline=None)
    @given(texts)
    def check(text):
        ids = want(path, text)
        own = bpe.speculative_bpe(path)
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == ids
        fast = encoder(path)
        assert np.frombuffer(fast.encode([text])[0], fast.dtype).tolist() == ids
        assert own.decode(np.array(ids, np.int64)).decode() == library(path).decode(ids, skip_special_tokens=False)

    check()


def test_word_merging_equals_the_library_on_vocabulary_joins():
    own = encoder(WORD)
    pieces = [x.removesuffix("</w>") for x in library(WORD).get_vocab() if x.isascii() and x.isalpha()]
    words = [(a + b).lower() for a, b in zip(pieces[:4000], pieces[4000:8000])]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encoded(words)] == [want(WORD, w) for w in words]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoders_equal_the_library_on_all_documents(path):
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    ids = [x.ids for x in library(path).encode_batch(texts, add_special_tokens=False)]
    for own in (encoder(path), bpe.speculative_bpe(path)):
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == ids


def test_bpe_digests(odd_docs, no_docs):
    got = bpe.bpe_digests(odd_docs, WORD).collect()
    rows = odd_docs.collect()
    assert len(got) == len(rows)
    expected = sorted(
        (r.doc_id is None, r.doc_id or 0, len(ids := want(WORD, r.text)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library(WORD).decode(ids, skip_special_tokens=False).encode()).hexdigest()) for r in rows
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    assert bpe.bpe_digests(no_docs, WORD).count() == 0
    decoded = bpe.bpe_decode(bpe.bpe_encode(odd_docs.where("doc_id = 7"), WORD), WORD).first().text
    assert decoded == library(WORD).decode(want(WORD, odd_docs.where("doc_id = 7").first().text), skip_special_tokens=False)


def test_token_store(spark, odd_docs, no_docs, tmp_path):
    out = f"{shared_dir(spark)}/store-test-{uuid.uuid4().hex}"
    token_store.write_store(odd_docs, out, WORD)
    got = sorted(token_store.read_digests(spark, out).collect(), key=lambda r: r.start)
    total = 0
    for r in got:
        assert r.start == total
        total += r.n_tokens
    rows = odd_docs.collect()
    crc = lambda t: zlib.crc32(np.array([*want(WORD, t), 1], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((r.doc_id or -1, len(want(WORD, r.text)) + 1, crc(r.text)) for r in rows)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))
    ids = {(r.doc_id, r.start): r.ids for r in token_store.read_ids(spark, out).collect()}
    assert all(zlib.crc32(np.array(ids[r.doc_id, r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)
    packs = spark.read.parquet(f"{out}/packs")
    once = packs.where("payload is not null").groupBy("digest").count()
    assert once.where("count > 1").count() == 0 and once.count() == packs.select("digest").distinct().count()
    assert token_store.verify_manifest(spark, out)
    # A recipe whose chunk ends elsewhere isn't the manifest's.
    recipes = spark.read.parquet(f"{out}/recipes")
    moved = recipes.withColumn("chunks", F.transform("chunks", lambda x: x.withField("stop", x["stop"] + 1)))
    for part in ("packs", "manifest", "about"):
        spark.read.parquet(f"{out}/{part}").write.parquet(f"{out}-moved/{part}")
    moved.write.parquet(f"{out}-moved/recipes")
    for read in (token_store.read_digests, token_store.read_ids):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, f"{out}-moved")
    token_store.write_store(no_docs, out + "-none", WORD)
    assert token_store.read_digests(spark, out + "-none").count() == 0


def test_chunks_follow_content():
    r = np.random.default_rng(1)
    a = r.integers(0, 49000, 20000)
    b = np.concatenate([a[:5000], r.integers(0, 49000, 7), a[5000:]])
    cuts = [token_store.cut_points(x, np.array([0, len(x)]))[0] for x in (a, b)]
    chunks = [{x[i:j].tobytes() for i, j in zip([0, *c], c)} for x, c in zip((a, b), cuts)]
    assert len(chunks[0] & chunks[1]) > 0.9 * len(chunks[0]) and max(np.diff([0, *cuts[0]])) <= token_store.LONGEST


def check_packing(got, docs):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    total = sum(r.length for r in got)
    assert len(by_sequence) == max(by_sequence) + 1 == total // 1024 + (total % 1024).bit_count()
    assert sum(r.length for r in got) == sum(len(want(BYTE, d.text)) + 1 for d in docs)
    for d in docs:
        ids = np.array([*want(BYTE, d.text), 0], "<u4")
        pieces = sorted(by_doc[d.doc_id, len(ids)], key=lambda p: p.start)
        assert all(zlib.crc32(ids[p.start : p.start + p.length]) == p.ids_crc32 for p in pieces)
        assert {p.start for p in pieces} >= {0}


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}, {"b": 1.0}])
def test_packing(odd_docs, no_docs, weights):
    got = packing.pack(odd_docs, BYTE, weights=weights, window_sequences=2, block_windows=2).collect()
    check_packing(got, odd_docs.collect())
    assert packing.pack(no_docs, BYTE, weights=weights).count() == 0


def test_windows_hold_the_mixture():
    sizes = np.array([7001, 2503, 499, 3])
    takes = packing.shares(sizes, 1000)
    assert np.array(takes).sum(axis=0).tolist() == sizes.tolist()
    assert all(t.sum() == 1000 for t in takes[:-1])
    target = np.cumsum([sizes / sizes.sum() * 1000] * (len(takes) - 1), axis=0)
    assert np.abs(np.cumsum(takes[:-1], axis=0) - target).max() < 2


def test_packed_windows_hold_their_weights(spark):
    """Through pack itself: while the sources last, each window has its weighted share of every one, and no token is lost afterwards."""
    r = random.Random(6)
    rows = [(k, "abcd"[k % 4], " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([5, 200, 900])))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    weights = {"a": 3.0, "b": 2.0, "c": 1.0}
    pieces = packing.pack(docs, BYTE, weights=weights).join(docs.select("doc_id", "source"), "doc_id").collect()
    window = packing.SEQUENCE * packing.WINDOW_SEQUENCES
    total = Counter()
    taken = defaultdict(Counter)
    for p in pieces:
        total[p.source] += p.length
        at, left = p.sequence_id * packing.SEQUENCE + p.offset, p.length
        while left:
            part = min(left, window - at % window)
            taken[at // window][p.source] += part
            at, left = at + part, left - part
    want = Counter()
    for p in {(p.doc_id, p.source, p.doc_tokens) for p in pieces}:
        want[p[1]] += p[2]
    assert total == want and set(total) == set("abcd")
    lasting = int(min(total[x] / (weights[x] / 6 * window) for x in weights)) - 1
    assert lasting >= 2
    sums = Counter()
    for k in range(lasting):
        sums.update(taken[k])
        assert sums["d"] == 0 and all(abs(sums[x] - weights[x] / 6 * window * (k + 1)) < 3 for x in weights), (k, sums)
