"""The near-dedup stage goes by SimHash first; the prefix filter is for what SimHash misses."""

import random

import numpy as np
import pytest

from geoweft.llm import neardup, simhash


def texts_in_pairs(n, words, edits, seed):
    """(doc_id, text): 2 k and 2 k + 1 differ in so many words in a row."""
    r = random.Random(seed)
    for k in range(n):
        own = [f"w{r.randrange(9000)}" for _ in range(words)]
        at = r.randrange(words - edits + 1)
        yield 2 * k, " ".join(own)
        yield 2 * k + 1, " ".join([*own[:at], *[f"x{r.randrange(9000)}" for _ in range(edits)], *own[at + edits :]])


@pytest.mark.parametrize("tile", [8, simhash.TILE])
def test_neighbours_equal_brute_force(spark, tile):
    r = np.random.default_rng(4)
    seeds = r.integers(0, 1 << 63, 60)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(6):
            fps.add(int(s) ^ sum(1 << int(b) for b in r.choice(63, r.integers(1, 9), replace=False)))
    own = np.array(sorted(fps), np.uint64)
    apart = np.bitwise_count(own[:, None] ^ own[None, :]).astype(int)
    np.fill_diagonal(apart, 64)
    at = {int(x): k for k, x in enumerate(own)}
    got = simhash.neighbours(spark.createDataFrame([(int(x),) for x in own], "fp long"), 12, 4, tile).collect()
    nearest = {}
    for a, b in got:
        d = apart[at[a], at[b]]
        assert 0 < d <= 12
        nearest[a] = min(d, nearest.get(a, 64))
    assert len(got) <= 2 * len(own)
    for x, d in zip(own, apart.min(axis=1)):
        assert d > 4 or nearest[int(x)] == d
    assert len(nearest) > 0.9 * (apart.min(axis=1) <= 12).sum()


def test_simhash_joins_near_copies_without_the_prefix_filter(spark, monkeypatch):
    rows = list(texts_in_pairs(50, 300, 1, 1))
    df = spark.createDataFrame([*rows, (1000, ""), (1001, None)], "doc_id long, text string")
    prefixes = neardup.shared_prefixes
    monkeypatch.setattr(neardup, "shared_prefixes", lambda *args: prefixes(*args).limit(0))
    kept = {x.doc_id for x in neardup.representatives(df).collect()}
    assert {2 * k for k in range(50)} <= kept and 1000 in kept and 1001 not in kept
    assert sum(k % 2 for k in kept) <= 1


def test_simhash_finds_most_pairs_just_over_the_limit(spark):
    """Similarity 0.81 to 0.83; and candidates are few."""
    rows = list(texts_in_pairs(200, 400, 36, 2))
    df = spark.createDataFrame(rows, "doc string, text string")
    ids = neardup.set_ids(df, 5).cache()
    doc = {x.id: int(x.doc) for x in ids.collect()}
    got = {tuple(sorted((doc[a], doc[b]))) for a, b in neardup.simhash_pairs(ids).collect()}
    ids.unpersist()
    sets = [set(zip(*[text.split()[k:] for k in range(5)])) for _, text in rows]
    alike = {(i, i + 1) for i in range(0, len(rows), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert len(alike) == 200 and len(alike & got) > 140 and len(got) < 2 * len(rows)


def test_a_family_makes_few_candidates(spark):
    """Six hundred sets that all lie near each other, many with one fingerprint."""
    words = [f"w{k}" for k in range(400)]
    rows = [(str(k), " ".join([*words[: k % 300], f"x{k % 500}", *words[k % 300 + 1 :]])) for k in range(600)]
    ids = neardup.set_ids(spark.createDataFrame(rows, "doc string, text string"), 5).cache()
    sets = ids.select("id").distinct().count()
    pairs = neardup.simhash_pairs(ids).collect()
    ids.unpersist()
    assert 0.9 * sets < len(pairs) < 3 * sets
