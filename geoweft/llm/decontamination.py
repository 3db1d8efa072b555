"""Operator 12: benchmark decontamination with an Aho-Corasick automaton.

Test items are normalised (A-Z in lower case, words of letters, digits and
everything outside ASCII) and cut into windows of WINDOW consecutive words; an
item of fewer words is one window. The automaton holds the windows, a word as
two symbols; documents, normalised likewise, pass through it once. A word that
no item has sends it back to its root, so only stretches of known words are fed.
Matches are word numbers, and these are mapped to code points of the original.

The automaton is sent to the tasks, so its size is bounded: items are dealt into
blocks of at most BLOCK_WORDS words (long items into pieces that overlap by a
window), each block has its automaton and its pass over the documents, and what
the passes find is united by document. A usual benchmark is one block.

Defined cases: null text has no words; rows of documents repeat as they come;
rows of one item_id are one item with the windows of each; rows without item_id
are one item named "null"; items without words have no window; an empty
benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions.running import range_numbered, running_total
from geoweft.llm.common import numbered, shuffle_partitions, staged, temporary, text_slices

WINDOW = 10
#: Words of the items of one automaton, at most; it has up to 20 nodes of some 60 bytes for each.
BLOCK_WORDS = 100_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RUN = "struct<first:long, after:long, start:long, end:long>"


def words_of(text: str | bytes) -> list[bytes]:
    """Normalised words; in UTF-8, a byte above 127 is part of a code point above 127."""
    return WORD.findall((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower())


def pieces(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """(item, at, n, words): items in pieces of at most so many words, each with the last window - 1 words of the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                step = max(1, most - window + 1)
                for at in range(0, max(1, len(words) - window + 1), step) if words else ():
                    rows.append((item, at, len(words[at : at + most]), b" ".join(words[at : at + most])))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["item", "at", "n", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return rows.mapInArrow(run, "item string, at long, n long, words binary").distinct()


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """pieces() with block, stored: pieces in order, a block has at most twice so many words."""
    order = ["item", "at", "words"]
    ranged = range_numbered(pieces(benchmark, window, most), order, shuffle_partitions(benchmark.sparkSession), "bucket", "items")
    total = running_total(ranged, "n", order, "bucket", "before")
    return staged(total.select("item", "n", "words", F.floor(F.col("before") / most).alias("block")), "item-blocks")


class Automaton:
    """The windows of some items. Built in each worker from their words, once."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int) -> None:
        self.rows, self.window, self._made = rows, window, None

    def __getstate__(self) -> tuple[list[tuple[str, bytes]], int]:
        return self.rows, self.window

    def __setstate__(self, state: tuple[list[tuple[str, bytes]], int]) -> None:
        self.rows, self.window = state
        self._made = None

    def made(self) -> tuple[dict[bytes, int], ahocorasick.Automaton, int]:
        """Numbers of words, from 1 on; the automaton; words of its shortest window."""
        if self._made is None:
            number: dict[bytes, int] = {}
            items: dict[tuple[int, ...], set[str]] = {}
            for item, text in self.rows:
                ids = [number.setdefault(w, len(number) + 1) for w in text.split(b" ")]
                for at in range(max(1, len(ids) - self.window + 1)):
                    items.setdefault(tuple(ids[at : at + self.window]), set()).add(item)
            found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for ids, names in items.items():
                found.add_word(tuple(_symbols(np.array(ids)).tolist()), (len(ids), tuple(names)))
            found.make_automaton()
            self._made = number, found, min(map(len, items))
        return self._made

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of words, ends exclusive, apart and in order; names of the items."""
        number, automaton, least = self.made()
        ids = np.fromiter((number.get(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids > 0, [False])).astype(np.int8)))
        found: list[tuple[int, int]] = []
        names: set[str] = set()
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start >= least:
                for last, (n, items) in automaton.iter(tuple(_symbols(ids[start:end]).tolist())):
                    after = start + last // 2 + 1
                    found.append((after - n, after))
                    names.update(items)
        return united(found), names


def _symbols(ids: np.ndarray) -> np.ndarray:
    """Two symbols a word, of two alphabets, so that no node has very many children."""
    return np.stack([ids >> 8, -1 - (ids & 255)], axis=1).ravel() + 256


def united(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _placed(text: str, stretches: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Stretches of words with their code points in the text as it is."""
    if not stretches:
        return []
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(data.lower())]
    # A code point begins at each byte that doesn't continue one.
    points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [{"first": a, "after": b, "start": int(points[spans[a][0]]), "end": int(points[spans[b - 1][1]])} for a, b in stretches]


def _pass(docs: DataFrame, key: str, automaton: Automaton | None, all_rows: bool) -> DataFrame:
    """(key, n_words, runs, items) of the documents, or of those alone in which something was found."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            keys, rows = [], []
            for own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                stretches, names = automaton.find(words) if automaton else ([], set())
                if all_rows or stretches:
                    keys.append(own)
                    rows.append((len(words), _placed(text or "", stretches), sorted(names)))
            n, runs, items = zip(*rows, strict=True) if rows else ((), (), ())
            run_type = pa.struct([(x, pa.int64()) for x in ("first", "after", "start", "end")])
            arrays = [pa.array(keys, part.schema.field(0).type), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_words", "runs", "items"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<{RUN}>, items array<string>")


def _united_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """runs of all blocks as stretches that are apart."""
    for part in batches:
        at = part.schema.get_field_index("runs")
        runs = []
        for row in part.column(at).to_pylist():
            place = {x["first"]: x["start"] for x in row}
            ends = {x["after"]: x["end"] for x in row}
            runs.append([{"first": a, "after": b, "start": place[a], "end": ends[b]} for a, b in united([(x["first"], x["after"]) for x in row])])
        yield part.set_column(at, part.schema.field(at), pa.array(runs, part.schema.field(at).type))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every document: doc_id, n_words, runs (hit stretches of words, first to after, and their code points, start to end), items (sorted)."""
    with temporary(docs.sparkSession):
        dealt = blocks(benchmark, window, block_words)
        numbers = [x.block for x in dealt.select("block").distinct().orderBy("block").collect()]
        automata = [Automaton([(x.item, bytes(x.words)) for x in dealt.where(F.col("block") == b).collect()], window) for b in numbers]
    if len(automata) < 2:
        return _pass(docs, "doc_id", automata[0] if automata else None, True)
    rows, key = numbered(docs.select("doc_id", "text"), "row")
    found = _pass(rows, key, automata[0], True)
    for automaton in automata[1:]:
        found = found.unionByName(_pass(rows, key, automaton, False))
    one = found.groupBy(key).agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in one.schema)
    return rows.select(key, "doc_id").join(one.mapInArrow(_united_rows, kinds), key).drop(key)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit code points, start:end, comma-joined) of every document."""
    found = overlaps(docs, benchmark)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])
    spans = F.array_join(F.transform("runs", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), spans.alias("spans"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)



_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Windows of the documents joined to windows of the items, by their words.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w, text FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS content
  FROM items, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, size, k, array_to_string(w[k : k + size - 1], ' ') AS content FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS t(k)),
found AS (SELECT p.r, p.k, p.size, x.item FROM places p JOIN windows x USING (size, content)),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT DISTINCT r, k, size FROM found), unnest(range(k, k + size)) AS t(j) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.list, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (r) LEFT JOIN named i USING (r)
"""
