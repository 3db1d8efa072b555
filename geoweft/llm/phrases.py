"""Operator 11: phrase collocations, counted in suffix subtrees of vertical partitions.

Texts, A-Z in lower case, are cut at punctuation and line ends into pieces, and
these into words; all is kept by language. From each word on, the next words of
the piece, DEPTH at most, are a suffix. A subtree holds the suffixes that begin
with one class of prefixes; so many classes are packed together as BUDGET
suffixes allow, and each pack is one group, sorted by itself: its sorted
suffixes are the leaves of a tree cut off at DEPTH, and a phrase's count is the
total of the leaves below it.

Prefixes are classed by hash, first by one word. The words' counts, made in a
pass of their own, say how many suffixes a class has. One of more than BUDGET is
cut by the next word as well, after a pass that counts these, and so on up to
DEPTH words; there, equal suffixes have become one row per slice of text. What
the tasks are told is a number for each class, at most some eight for each
BUDGET of suffixes. Where a prefix is dealt to several groups, its count is the
sum of theirs.

Words that occur less than LEAST times end a suffix, as no phrase with them
counts; tasks know them by a table of bits that all other words have set (2^26
bits at most; more words only leave more suffixes in).

Defined cases: null text is empty, null lang is "und"; rows repeat as they come;
a text or an empty table without words gives no rows; scores are exact decimals;
ties go by phrase; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm.common import looked_up, staged, temporary

DEPTH, LEAST, TOP = 4, 30, 2000
#: Suffixes of a group; bytes of text in a slice, whose equal words and suffixes are one row.
BUDGET, SLICE = 1_000_000, 8 << 20
MOST_BITS = 1 << 26
#: What ends a piece.
STOPS = b".,;:!?\n\x0b\x0c\r"
_STOP, _SPACE = 255, 32  # neither is part of a word in UTF-8
_TABLE = bytes(_STOP if b in STOPS else _SPACE if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of about most bytes, normalised; texts are joined by stops, and cut at stops alone."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        texts = batch.column(1)
        for k, lang in enumerate(batch.column(0).to_pylist()):
            if not texts[k].is_valid:
                continue
            text = texts[k].as_buffer().to_pybytes().translate(_TABLE)
            while len(text) > most and (at := text.find(_STOP, most)) >= 0:
                yield lang, text[:at]
                text = text[at + 1 :]
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= most:
                yield lang, bytes([_STOP]).join(held.pop(lang))
                sizes.pop(lang)
            elif sum(sizes.values()) >= 2 * most:  # many languages of little text each
                yield from ((x, bytes([_STOP]).join(held[x])) for x in held)
                held, sizes = {}, {}
    yield from ((x, bytes([_STOP]).join(held[x])) for x in held)


def coded(text: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of the words in order, the piece that each is in, the distinct words)."""
    a = np.frombuffer(text, np.uint8)
    inside = (a != _SPACE) & (a != _STOP)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.binary())
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])])
    found = words.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(a == _STOP), starts)
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, found.dictionary


def hashes(lang: str, words: pa.Array) -> np.ndarray:
    """CRC of lang and word, as Spark's crc32 makes it of both joined by a zero byte."""
    start = zlib.crc32(lang.encode("utf-8", "surrogatepass") + b"\0")
    return np.fromiter((zlib.crc32(w, start) for w in words.to_pylist()), np.int64, len(words))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in slices(batches):
            codes, _, words = coded(text)
            n = np.bincount(codes, minlength=len(words))
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000].cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(n[at : at + 50_000])], names=["lang", "word", "f"])

    return _texts(docs).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


@dataclass
class Layout:
    """How suffixes are dealt: for each class of a level, its group, or -1 and where the classes of the next level begin."""

    bits: np.ndarray  # packed; set for all words of LEAST and more
    group: list[np.ndarray] = field(default_factory=list)
    begin: list[np.ndarray] = field(default_factory=list)  # first class of the next level
    split: list[np.ndarray] = field(default_factory=list)  # number of classes there
    level: list[int] = field(default_factory=list)  # of each group

    def suffixes(self, lang: str, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(codes of suffixes of two words and more, a row each, 0 where one has ended; how often; hashes by code; words by code - 1) of a slice."""
        codes, piece, words = coded(text)
        h = np.concatenate(([0], hashes(lang, words)))
        often = np.concatenate(([False], self._often(h[1:])))
        codes = codes + 1
        goes = np.concatenate(((piece[1:] == piece[:-1]) & often[codes[1:]], [False])) if len(codes) else np.zeros(0, bool)
        at = np.flatnonzero(goes & often[codes])
        columns, on = [codes[at]], np.ones(len(at), bool)
        for k in range(1, DEPTH):
            on = on & goes[np.minimum(at + k - 1, len(codes) - 1)]
            columns.append(np.where(on, codes[np.minimum(at + k, len(codes) - 1)], 0))
        # Equal suffixes are one row: two halves of two words each, numbered, make one key.
        halves = [pa.array(columns[k] << 32 | columns[k + 1]).dictionary_encode() for k in (0, 2)]
        key = halves[0].indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | halves[1].indices.to_numpy(zero_copy_only=False)
        counted = pa.array(key).value_counts()
        key, n = (counted.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        first, second = (halves[k].dictionary.to_numpy(zero_copy_only=False)[x] for k, x in ((0, key >> 32), (1, key & 0xFFFFFFFF)))
        mask = 0xFFFFFFFF
        return np.stack([first >> 32, first & mask, second >> 32, second & mask], axis=1), n, h, words

    def _often(self, h: np.ndarray) -> np.ndarray:
        at = h & (len(self.bits) * 64 - 1)
        return (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def classes(self, rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each suffix, or -1; its class at the deepest level yet)."""
        at = h[rows[:, 0]] & (len(self.group[0]) - 1) if self.group else np.zeros(len(rows), np.int64)
        group = self.group[0][at] if self.group else np.full(len(rows), -1)
        for k in range(1, len(self.group)):
            open_ = np.flatnonzero(group < 0)
            at[open_] = self.begin[k - 1][at[open_]] + h[rows[open_, k]] % self.split[k - 1][at[open_]]
            group[open_] = self.group[k][at[open_]]
        return group, at

    def deal(self, totals: np.ndarray, budget: int, last: bool) -> bool:
        """Packs the classes of another level, of which totals are known. Whether some must be split again."""
        wide = (totals > budget) & (not last)
        before = np.where(wide | (totals == 0), 0, totals).cumsum()
        group = np.where(wide, -1, len(self.level) + before // max(1, budget))
        fresh = int(group.max(initial=len(self.level) - 1)) + 1 - len(self.level)
        self.level += [len(self.group) + 1] * fresh
        split = np.where(wide, np.exp2(np.ceil(np.log2(np.maximum(4 * totals / budget, 1)))), 0).astype(np.int64)
        self.group.append(group)
        self.begin.append(split.cumsum() - split)
        self.split.append(split)
        return bool(wide.any())


def layout(docs: DataFrame, words: DataFrame, budget: int = BUDGET, least: int = LEAST) -> Layout:
    """Vertical partitions of the suffixes of all texts. words: word_counts(), stored."""
    often = words.where(F.col("f") >= least).withColumn("h", F.crc32(F.encode(F.concat("lang", F.lit("\0"), "word"), "utf-8")))
    known = often.agg(F.count("*").alias("n"), F.sum("f").alias("f")).first()
    n_bits = min(MOST_BITS, 1 << max(6, (16 * known.n).bit_length()))
    bits = np.zeros(n_bits // 64, np.uint64)
    place = F.col("h").bitwiseAND(n_bits - 1)
    for part in often.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {n_bits - 1}) & 63 as int))")).alias("b")).toPandas().itertuples():
        bits[part.at] = np.int64(part.b).view(np.uint64)
    done = Layout(bits)
    size = 1 << max(6, (4 * (known.f or 0) // budget).bit_length())
    totals = np.zeros(size, np.int64)
    for part in often.groupBy(F.col("h").bitwiseAND(size - 1).alias("at")).agg(F.sum("f").alias("f")).toPandas().itertuples():
        totals[part.at] = part.f
    level = 1
    while done.deal(totals, budget, level == DEPTH):
        size = int(done.split[-1].sum())
        totals = np.zeros(size, np.int64)
        for part in class_counts(docs, done).toPandas().itertuples():
            totals[part.at] = part.n
        level += 1
    return done


def class_counts(docs: DataFrame, so_far: Layout) -> DataFrame:
    """(at, n): suffixes in each class that the classes yet too large fall into by their next word."""
    depth = len(so_far.group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in slices(batches):
            rows, n, h, _ = so_far.suffixes(lang, text)
            group, at = so_far.classes(rows, h)
            open_ = np.flatnonzero(group < 0)
            at = so_far.begin[-1][at[open_]] + h[rows[open_, depth]] % so_far.split[-1][at[open_]]
            each, where = np.unique(at, return_inverse=True)
            # Equal suffixes of a slice are one row, and rows are what a group must hold.
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.bincount(where, minlength=len(each)).astype(np.int64))], names=["at", "n"])

    return _texts(docs).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def _packed(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, compressed: the higher ones are nearly all zero."""
    planes = np.ascontiguousarray(numbers).reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def dealt(docs: DataFrame, by: Layout) -> DataFrame:
    """(group, lang, words, codes, n): for each slice and group, its suffixes as numbers into its own list of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in slices(batches):
            rows, n, h, words = by.suffixes(lang, text)
            group, _ = by.classes(rows, h)
            order = np.argsort(group, kind="stable")
            rows, n, group = rows[order], n[order], group[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)])) if len(group) else np.zeros(1, np.int64)
            for start, end in zip(cuts, cuts[1:], strict=False):
                used = np.zeros(len(words) + 1, bool)
                used[rows[start:end]] = True
                used[0] = True
                small = (np.cumsum(used) - 1).astype(np.uint16 if used.sum() <= 1 << 16 else np.uint32)
                own = words.take(pa.array(np.flatnonzero(used)[1:] - 1))
                blob = _packed(small[rows[start:end].T])
                arrays = [pa.array([int(group[start])], pa.int64()), pa.array([lang]), pa.array([zstandard.compress(b" ".join(own.to_pylist()), 3)]), pa.array([blob]), pa.array([_packed(n[start:end].astype(np.uint32))])]
                yield pa.RecordBatch.from_arrays(arrays, names=["group", "lang", "words", "codes", "n"])

    return _texts(docs).mapInArrow(run, "group long, lang string, words binary, codes binary, n binary")


def subtrees(parts: DataFrame, by: Layout, least: int = LEAST) -> DataFrame:
    """(lang, phrase, m, f): inner nodes of each group's tree: phrases of m words, 2 at least, with the totals of their leaves."""
    levels = by.level

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        langs = part.column("lang").combine_chunks().dictionary_encode()
        lists = [zstandard.decompress(x.as_py()).split(b" ") for x in part.column("words")]
        words = pa.concat_arrays([pa.array(x, pa.binary()) for x in lists]).dictionary_encode()
        number = np.concatenate(([0], words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1))
        at, lang, columns, n = 0, [], [[], [], [], []], []
        for own, size, codes, times in zip(langs.indices.to_pylist(), map(len, lists), part.column("codes"), part.column("n"), strict=True):
            counts = _unpacked(times.as_py(), np.uint32)
            raw = _unpacked(codes.as_py(), np.uint16 if size + 1 <= 1 << 16 else np.uint32).reshape(DEPTH, -1)
            for k in range(DEPTH):
                columns[k].append(np.where(raw[k] > 0, number[raw[k].astype(np.int64) + at], 0))
            lang.append(np.full(len(counts), own, np.int32))
            n.append(counts)
            at += size
        leaves = [np.concatenate(lang), *map(np.concatenate, columns)]
        n = np.concatenate(n).astype(np.int64)
        order = np.lexsort((leaves[3] << 32 | leaves[4], leaves[1] << 32 | leaves[2], leaves[0]))
        leaves, n = [x[order] for x in leaves], n[order]
        new = np.concatenate(([True], (leaves[0][1:] != leaves[0][:-1]) | (leaves[1][1:] != leaves[1][:-1])))
        out = []
        for m in range(2, DEPTH + 1):
            new = new | np.concatenate(([True], leaves[m][1:] != leaves[m][:-1]))
            heads = np.flatnonzero(new)
            f = np.add.reduceat(n, heads)
            # A prefix shorter than its group's level has leaves in other groups too.
            keep = (leaves[m][heads] > 0) & ((f >= least) | (m < levels[key[0].as_py()]))
            heads, f = heads[keep], f[keep]
            if len(heads):
                texts = [words.dictionary.take(pa.array(leaves[k][heads] - 1)).cast(pa.string()) for k in range(1, m + 1)]
                out.append(pa.table([langs.dictionary.take(pa.array(leaves[0][heads])), pa.compute.binary_join_element_wise(*texts, " "), pa.array(np.full(len(heads), m, np.int32)), pa.array(f)], names=["lang", "phrase", "m", "f"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64())], names=["lang", "phrase", "m", "f"])

    return parts.groupBy("group").applyInArrow(run, "lang string, phrase string, m int, f long")


def phrase_counts(docs: DataFrame, budget: int = BUDGET, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, f) of all phrases of 1 to DEPTH words that occur least times; (lang, n) of all words), both stored."""
    with temporary(docs.sparkSession):
        words = staged(word_counts(docs), "phrase-words")
        by = layout(docs, words, budget, least)
        found = subtrees(dealt(docs, by), by, least).groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        single = words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("m"), "f")
        phrases = staged(found.unionByName(single), "phrases", keep=True)
        totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals", keep=True)
    return phrases, totals


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, score) of phrases of two words and more, at their lowest cut."""
    counted = phrases.where("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = counted.select("lang", "phrase", "m", F.col("f").alias("a"), "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - m)").alias("rest"))
    cuts = staged(cuts, "phrase-cuts")
    total = cuts.count()
    for part, out in (("first", "l"), ("rest", "r")):
        used = cuts.groupBy("lang", F.col(part).alias("phrase")).agg(F.count("*").alias("times"))
        known = staged(used.join(phrases.select("lang", "phrase", "f"), ["lang", "phrase"]).select("lang", F.col("phrase").alias(part), F.col("f").alias(out), "times"), "phrase-parts")
        cuts = looked_up(cuts, known, ["lang", part], "times", total)
    exact = "cast((2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("x")
    return cuts.groupBy("lang", "phrase", "m", "a").agg(lowest).select("lang", "phrase", "m", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases."""
    phrases, totals = phrase_counts(docs, budget)
    candidates = staged(scored(phrases), "phrase-scores")
    # Every shorter phrase of two words and more inside a candidate, with the most frequent candidate around it.
    inner = F.expr("flatten(transform(sequence(2, m - 1), size -> transform(sequence(1, m - size + 1), at -> array_join(slice(split(phrase, ' '), at, size), ' '))))")
    around = candidates.where("m > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left")
    kept = kept.where("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: All phrases of one to four words grouped as texts.
ORACLE_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
phrases AS (
  SELECT lang, array_to_string(w[k : k + m - 1], ' ') AS phrase, m, count(*) AS f
  FROM words, unnest(range(1, {DEPTH + 1})) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(k) GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, phrase, m, f AS a, k, string_split(phrase, ' ') AS w FROM phrases, unnest(range(1, m)) AS t(k) WHERE m > 1),
scores AS (
  SELECT c.lang, c.phrase, c.m, c.a, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score, c.k
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
candidates AS (SELECT * EXCLUDE (k) FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[k : k + size - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, unnest(range(2, m)) AS s(size), unnest(range(1, m - size + 2)) AS t(k) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer x USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY rank <= {TOP}
"""
