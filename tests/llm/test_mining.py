"""Operators 11, 12 and 13 against their definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.llm import decontamination, phrases, whitening


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def slow_collocations(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        rank = []
        for p, a in found.items():
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and inside(q) and 100 * b >= 80 * a for q, b in found.items()):
                rank.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def phrase_rows(seed, n):
    r = random.Random(seed)
    words = [*"abcdefgh", "The", "the", "é", "ü🙂", "x y", "z\x1c", "#"]
    texts = [" ".join(r.choice(words[: r.choice([2, 5, len(words)])]) + r.choice(["", "", "", "", ".", "\n", "\t", "!?", "  "]) for _ in range(r.choice([0, 1, 4, 30, 120]))) for _ in range(n)]
    return [(r.choice(["en", "de", None, "und", ""]), t) for t in texts]


@pytest.mark.parametrize("budget", [2_000_000, 300, 20])
def test_collocations_equal_their_definition(spark, budget):
    """Small budgets split prefixes to the second, third and fourth word, and counts are summed across groups."""
    rows = [*phrase_rows(budget, 120), ("en", None), ("en", ""), (None, " . ,"), *[("en", "same words here again and again")] * 40]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, budget=budget)
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))


def test_small_budgets_split_to_the_last_word(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([("en", " ".join(r.choice("aaaab") for _ in range(400)) + " " + " ".join(r.choice("abcdefgh") for _ in range(400))) for _ in range(5)], "lang string, text string").repartition(5)
    words = phrases.word_counts(docs).cache()
    by = phrases.layout(docs, words, budget=4)
    assert max(by.level) == phrases.DEPTH and len(by.group) == phrases.DEPTH
    wide = phrases.layout(docs, words)
    assert wide.level == [1]


def test_slices_cut_at_stops_alone():
    import pyarrow as pa

    text = " ".join(f"w{k % 7}" + "." * (k % 50 == 0) for k in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "x y"])], names=["lang", "text"])
    parts = list(phrases.slices(iter([batch]), 1000))
    assert max(len(p) for _, p in parts) < 3000 and len(parts) > 5
    pieces = [p.split() for _, part in parts for p in part.split(b"\xff") if p.split()]
    assert pieces == [p.encode().split() for p in [*text.split("."), "x y"] if p.split()]


def test_collocations_of_odd_tables(spark, odd_docs, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    rows = [(x.lang, x.text) for x in odd_docs.collect()]
    clashes = odd_docs.withColumns({x: F.lit(1) for x in ("word", "f", "phrase", "m", "a", "n", "k", "rank", "group", "codes", "words", "h", "at")})
    assert sorted(map(tuple, phrases.collocations(clashes).collect())) == slow_collocations(rows)


def slow_overlaps(docs, benchmark, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = defaultdict(set)
    for item, text in benchmark:
        w = word.findall(lower(text))
        items["null" if item is None else str(item)] |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
    out = []
    for doc, text in docs:
        found = list(word.finditer(lower(text)))
        w = [m[0] for m in found]
        hit, names = set(), set()
        for item, windows in items.items():
            for x in windows:
                for i in range(len(w) - len(x) + 1):
                    if tuple(w[i : i + len(x)]) == x:
                        hit |= set(range(i, i + len(x)))
                        names.add(item)
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        spans = []
        for i in starts:
            j = i
            while j + 1 in hit:
                j += 1
            spans.append((found[i].start(), found[j].end()))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), spans))
    return sorted(map(str, out))


def benchmark_rows(seed):
    r = random.Random(seed)
    words = ["The", "cat", "é", "Ünï", "x1", "sat"]
    some = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k if k % 9 else None, some(r.choice([0, 1, 3, 9, 10, 11, 25, 40]))) for k in range(30)] + [(3, some(12)), (4, None), (5, "  "), (40, "zebra quagga"), (41, "İstanbul KelvinK")]
    docs = [(k, some(r.choice([0, 2, 15])) + (r.choice(items)[1] or "").upper().replace("É", "é").replace("ÜNÏ", "Ünï") + " other " + some(r.choice([0, 5]))) for k in range(60)]
    return items, [*docs, (None, None), (7, ""), (7, docs[7][1]), (8, "🙂 zebra, Quagga! İstanbul KelvinK"), (9, "zebra quaggas")]


@pytest.mark.parametrize(("seed", "most"), [(1, 100_000), (2, 60), (3, 12)])
def test_overlaps_equal_their_definition(spark, seed, most):
    """Small blocks cut items into pieces and the benchmark into many automata."""
    items, docs = benchmark_rows(seed)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit("x"))
    got = decontamination.overlaps(df, bench, block_words=most).collect()
    shown = []
    for x in got:
        n = sum(r["after"] - r["first"] for r in x.runs)
        shown.append(str((x.doc_id, x.n_words, n, len(x["items"]), hashlib.sha256(",".join(sorted(x["items"])).encode()).hexdigest(), n > 0, [(r.start, r.end) for r in x.runs])))
    # Adjoining occurrences are one stretch in both.
    assert sorted(shown) == slow_overlaps(docs, items)
    if most > 1000:
        report = decontamination.report(df, bench)
        assert sorted(str((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated)) for x in report.collect()) == sorted(x[: x.index(", [")] + ")" for x in slow_overlaps(docs, items))


def test_overlaps_of_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "cat sat on the mat and looked at the dog")], "item_id long, text string")
    got = {(x.doc_id, x.contaminated) for x in decontamination.report(odd_docs, bench).collect()}
    assert got == {(1, True), (2, False), (3, False), (None, False), (5, False), (6, True), (7, False), (8, False)}
    assert decontamination.report(no_docs, bench).collect() == []
    assert not decontamination.report(odd_docs, bench.limit(0)).where("contaminated").count() and decontamination.report(odd_docs, bench.limit(0)).count() == odd_docs.count()


def slow_whitening(vectors, k=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    exact = n * x - s
    d = (exact / n).astype(float)
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, (exact * exact).sum(axis=1), d @ u / np.sqrt(e), e / (d * d).sum() * n


@pytest.mark.parametrize(("seed", "rows", "width"), [(1, 300, 64), (2, 50, 5), (3, 200, 40), (4, 400, 1)])
def test_whitening_equals_eigenvectors(spark, seed, rows, width):
    r = np.random.default_rng(seed)
    vectors = (r.standard_normal((rows, width)) @ r.standard_normal((width, width))).astype(np.float32)
    bad = [(-1, None), (-2, [None] * width), (-3, [float("nan")] * width), (-4, [float("inf")] * width), (-5, [])]
    df = spark.createDataFrame([*[(k, v.tolist()) for k, v in enumerate(vectors)], *bad], "vec_id long, embedding array<float>").withColumn("w", F.lit(1)).repartition(3)
    n, deviation, white, explained = slow_whitening(vectors)
    got = whitening.whitened(df).collect()
    assert len(got) == rows * min(32, width) and {x.n for x in got} == {n} and got[0].identity_error < 1e-10
    by = np.zeros_like(white)
    for x in got:
        by[x.vec_id, x.component - 1] = x.whitened
        assert x.deviation == deviation[x.vec_id] and abs(x.explained / explained[x.component - 1] - 1) < 1e-9
    signs = np.sign((by * white).sum(axis=0))
    assert np.abs(by * signs - white).max() < 1e-7


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    flat = spark.createDataFrame([(k, [float(k), float(k), 5.0]) for k in range(6)] + [(None, [1.0, 1.0, 5.0])] * 2 + [(9, [1.0])], schema)
    got = whitening.whitened(flat).collect()
    assert {x.component for x in got} == {1} and len(got) == 8 and got[0].n == 8 and abs(got[0].explained - 1) < 1e-12
    with pytest.raises(Exception, match="2\\^40"):
        whitening.whitened(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], schema)).collect()


def test_intervals_hold_as_many_as_their_inertia_says():
    r = np.random.default_rng(7)
    for size, rank in ((64, 64), (64, 5), (150, 150), (40, 39)):
        x = r.standard_normal((rank, size))
        v = x.T @ x
        v = np.diag(np.repeat([7.0, 3.0, 3.0, 1.0], size // 4)) if rank == 39 else v
        tri, e = whitening.tridiagonal(v), np.linalg.eigvalsh(v)
        for shift in np.linspace(e[0] - 1, e[-1] + 1, 50):
            assert whitening.above(tri, shift) == (e > shift).sum() or np.abs(e - shift).min() < 1e-9
        parts = whitening.intervals(v, 32)
        values = np.concatenate([whitening.contour(v, *p)[0] for p in parts])
        assert len(values) >= min(32, size) and np.allclose(values, e[::-1][: len(values)], atol=1e-9 * max(1, e[-1]))


@pytest.mark.parametrize("values", [np.logspace(6, -6, 48), np.r_[1e8, 1 + np.linspace(0, 0.5, 47)], np.repeat(np.arange(24) + 1.0, 2), 1e3 * 0.5 ** np.arange(48), 1 + 1e-7 * np.arange(48), np.r_[100 + 1e-9 * np.arange(20), 1 + 1e-3 * np.arange(28)]], ids=["wide", "one large", "pairs", "falling", "tight", "clusters"])
def test_hard_spectra(values):
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((48, 48)))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    parts = whitening.intervals(v, 32)
    found = [whitening.contour(v, *p) for p in parts]
    e, u = np.concatenate([x for x, _ in found]), np.hstack([x for _, x in found])
    assert len(e) >= 32 and np.abs(e - np.sort(values)[::-1][: len(e)]).max() < 1e-12 * values.max()
    assert np.abs(v @ u - u * e).max() < 1e-11 * values.max() and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-4  # before the last Ritz step
