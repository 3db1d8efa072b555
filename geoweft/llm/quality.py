"""Operator 7: quality rules by distribution divergence.

Two histograms describe a text: its character classes, and its common words.
References are the same histograms of each language, counted over all
documents. A document's verdict is its Jensen-Shannon distance (base 2, from 0
to 1) to the nearest language, its own or a large one, for each histogram: too
far from all of them means rejected. Short texts are only judged where the counts bear it: the
character test from MIN_CHARS characters, the word test from MIN_WORDS words.

Common words are the words of at most LONGEST letters that make up COMMON of
their language's words, so at most 1 / COMMON of them. A language is a
reference for its own documents if it has ENOUGH words or RARE of all, and for
all documents, whatever their language, if it has RARE of all. The driver holds
at most 1 / COMMON words of each reference.

Base rules come first: fewer than 50 words, or more than half the words in
three-word windows that occur twice.

Defined cases: null and empty texts have no words and fail the base rules;
null languages count as one language; rows repeat as they come; where a
document's own language is no reference, neither test is made.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import free_name, text_slices

LONGEST, COMMON, RARE, ENOUGH = 6, 0.002, 0.005, 5000
MIN_CHARS, MIN_WORDS = 200, 80
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.34
CLASSES = ["lower", "upper", "other letter", "digit", "space", "full stop", "comma", "other punctuation", "symbol", "mark", "else"]
SYMBOLS = b"#*$%&|<>"
STRIP = ".,;:!?\"'()[]{}#*$%&|<>-"


Reference = tuple[list[float], dict[str, float], bool]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane; the others share the last."""
    by = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Nd": 3, "Zs": 4, "Po": 7, "Pd": 7, "Ps": 7, "Pe": 7, "Pi": 7, "Pf": 7, "Sm": 8, "Sc": 8, "Sk": 8, "So": 8, "Mn": 9, "Mc": 9}
    out = np.array([by.get(unicodedata.category(chr(c)), 10) for c in range(1 << 16)], np.uint8)
    out[[*range(9, 14), 32]] = 4
    out[ord(".")], out[ord(",")] = 5, 6
    out[list(SYMBOLS)] = 8
    return out


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = class_table()
    counts = np.zeros(len(CLASSES), np.int64)
    for at in range(0, len(points), 1 << 20):
        counts += np.bincount(table[np.minimum(points[at : at + (1 << 20)], (1 << 16) - 1)], minlength=len(CLASSES))
    return counts


def plain(word: bytes) -> str:
    """The word as the histograms have it: lower case, without punctuation around it."""
    return word.decode("utf-8", "replace").strip(STRIP).lower()


def base_measures(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    word_chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\v\f\r")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return word_chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    c = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    pairs = c[:-1] * size + c[1:]
    if size > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, back, counts = np.unique(pairs[:-1] * size + c[2:], return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n): character classes and short words of all documents, per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(lang, "char", str(k), int(n)) for lang, x in chars.items() for k, n in enumerate(x) if n]
            for lang, found in words.items():
                rows.append((lang, "all words", "", sum(found.values())))
                merged: Counter = Counter()
                for w, n in found.items():
                    if len(w) <= 4 * LONGEST and 0 < len(x := plain(w)) <= LONGEST:
                        merged[x] += n
                rows += [(lang, "word", x, n) for x, n in merged.items()]
            chars.clear()
            words.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["lang", "kind", "key", "n"])

        for part in text_slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                lang = lang or ""
                chars[lang] = chars.get(lang, 0) + classes_of(text or "")
                words.setdefault(lang, Counter()).update((text or "").encode("utf-8", "surrogatepass").split())
            if sum(map(len, words.values())) > 150_000:
                yield from flush()
        yield from flush()

    counts = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, kind string, key string, n long")
    return counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> dict[str, Reference]:
    """Per language: shares of the character classes, and of its common words; and whether it is one for all documents."""
    counts = corpus_counts(docs).persist()
    try:
        all_words = counts.where("kind = 'all words'")
        every = all_words.agg(F.sum("n")).first()[0] or 0
        totals = {r.lang: r.n for r in all_words.where((F.col("n") > 0) & (F.col("n") >= min(ENOUGH, RARE * every))).collect()}
        chars: dict[str, list[float]] = {lang: [0.0] * len(CLASSES) for lang in totals}
        words: dict[str, dict[str, float]] = {lang: {} for lang in totals}
        if totals:
            sizes = all_words.select("lang", F.col("n").alias("total")).where(F.col("total") >= min(ENOUGH, RARE * every))
            some = counts.join(sizes, "lang")
            for r in some.where("kind = 'char'").collect():  # classes x languages
                if r.lang in chars:
                    chars[r.lang][int(r.key)] = float(r.n)
            for r in some.where("kind = 'word'").where(F.col("n") >= F.lit(COMMON) * F.col("total")).collect():  # at most 1 / COMMON a language
                if r.lang in words:
                    words[r.lang][r.key] = r.n / totals[r.lang]
    finally:
        counts.unpersist()
    return {lang: ([x / sum(chars[lang]) for x in chars[lang]], words[lang], totals[lang] >= RARE * every) for lang in sorted(totals) if sum(chars[lang])}


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


class Judge:
    def __init__(self, found: dict[str, Reference]):
        self.chars = {lang: np.array(c) for lang, (c, _, _) in found.items()}
        self.words = {}
        for lang, (_, w, _) in found.items():
            q = np.array([*w.values(), max(0.0, 1 - sum(w.values()))])
            self.words[lang] = ({x: k for k, x in enumerate(w)}, q)
        self.large = [lang for lang, (_, _, large) in found.items() if large]

    def distances(self, text: str, words: list[bytes], lang: str) -> tuple[float | None, float | None]:
        """To the nearest language, by characters and by words; None where the text is too short or its language no reference."""
        near_chars = near_words = None
        if lang not in self.chars:
            return None, None
        near = self.large if lang in self.large else [*self.large, lang]
        if len(text) >= MIN_CHARS:
            p = classes_of(text)
            near_chars = min(distance(p / p.sum(), self.chars[x]) for x in near)
        if len(words) >= MIN_WORDS:
            short = Counter(words)
            seen: Counter = Counter()
            for w, n in short.items():
                if len(w) <= 4 * LONGEST:
                    seen[plain(w)] += n
            near_words = 1.0
            for index, q in map(self.words.get, near):
                p = np.zeros(len(q))
                for x, n in seen.items():
                    if (k := index.get(x)) is not None:
                        p[k] += n
                p[-1] = len(words) - p.sum()
                near_words = min(near_words, distance(p / len(words), q))
        return near_chars, near_words


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def measure(judge: Judge, text: str, lang: str) -> tuple:
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars, symbols, dup_lines, repeat = base_measures(text, words)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    chars, common = judge.distances(text, words, lang)
    kept = not failed and not (chars is not None and chars > MOST_CHAR_DISTANCE) and not (common is not None and common > MOST_WORD_DISTANCE)
    return len(words), word_chars, symbols, dup_lines, repeat, failed, kept, chars, common


def judged(docs: DataFrame) -> DataFrame:
    """doc_id with the measures and the verdict, for every row."""
    found = references(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(found)
        for part in text_slices(batches):
            rows = [measure(judge, x or "", lang or "") for x, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), TYPES))], names=["doc_id", *NAMES])

    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, as they are."""
    found = references(docs)
    at = docs.columns.index("text")
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(found)
        for part in text_slices(batches, text=at):
            keep = [measure(judge, x or "", lang or "")[6] for x, lang in zip(part.column(at).to_pylist(), part.column(width).to_pylist())]
            yield part.select(range(width)).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(free_name(docs, "_quality_lang"), F.col("lang").cast("string")).mapInArrow(run, docs.schema)
