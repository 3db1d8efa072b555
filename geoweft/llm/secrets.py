"""Operator 9: secrets, and credentials whose parts only mean something together.

Strong findings (base kinds) come from their stated patterns. Weak candidates
are parts: identifiers (user names, client ids, key ids), endpoints (URLs and
hosts with ports) and secret-looking values. Parts are rows; an interval join
within the document links each weak part to a complementary one, at most SCOPE
code points away, and only linked parts are reported. A secret needs an
identifier or endpoint, these need a secret, weak or strong.

The join is an equi-join on (row, cell of SCOPE code points) with the exact
distance as a further condition, kept as a semi join: no pairs are made, and
a document's parts spread over its cells. A part is in all cells it touches,
its complement in all cells within SCOPE of it.

One place may be read in two roles (a key id or a key), and parts may overlap.
Each reading is linked to parts clear of it; only then the leftmost, longest
linked reading is chosen, a value before other roles.

Defined cases: null text has no spans; rows repeat as they come; positions are
code points, ends exclusive; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import free_name, numbered, staged, text_slices
from geoweft.llm.spans import Span, digest

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "ident", "endpoint", "value"]
SCOPE = 200
#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

IDENT = re.compile(r"""(?:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
IDENT_HINTS = ("user", "login", "client", "account", "access")
SCHEME_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
HOST_LETTERS = SCHEME_LETTERS - {"+"}
REST = re.compile(r"""[^\s"'<>]+""")
PORT = re.compile(r":[0-9]{2,5}\b", re.ASCII)
WEAK_ASSIGN = re.compile(r"""(?:pwd|pass(?:phrase)?|key|auth|credentials?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.IGNORECASE | re.ASCII)
WEAK_HINTS = ("pwd", "pass", "key", "auth", "credential")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _left_end(text: str, at: int, letters: frozenset[str]) -> int:
    while at and text[at - 1] in letters:
        at -= 1
    return at


def endpoints(text: str) -> list[Span]:
    """URLs, and hosts of two labels or more with a port. Each is found by its :// or its port, and from there to the left.

    Letters before one colon are never before another, so no place is looked at twice.
    """
    out: list[Span] = []
    past = 0
    while (colon := text.find("://", past)) >= 0:
        start = _left_end(text, colon, SCHEME_LETTERS)
        while start < colon and not text[start].isalpha():
            start += 1
        past = colon + 3
        if start < colon and (rest := REST.match(text, past)):
            past = rest.end()
            out.append(("endpoint", start, past))
    urls = iter(out[:])
    url = next(urls, None)
    for m in PORT.finditer(text):
        while url and url[2] <= m.start():
            url = next(urls, None)
        if url and url[1] <= m.start():
            continue
        start = _left_end(text, m.start(), HOST_LETTERS)
        start = max(start, text.rfind("..", start, m.start()) + 2) if ".." in text[start : m.start()] else start
        while start < m.start() and text[start] in "-.":
            start += 1
        if "." in text[start : m.start() - 1] and text[m.start() - 1] != ".":
            out.append(("endpoint", start, m.end()))
    return out


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Parts clear of the base spans. They may overlap, or be one place in two roles: that is settled after linking."""
    low, found = text.lower(), []
    if any(x in low for x in IDENT_HINTS):
        found += [("ident", *m.span(1)) for m in IDENT.finditer(text)]
    if ":" in text:
        found += endpoints(text)
    if any(x in low for x in WEAK_HINTS):
        found += [("value", *m.span(1)) for m in WEAK_ASSIGN.finditer(text)]
    if found or base:  # a lone random string has nothing to be linked to
        found += [("value", *m.span()) for m in RANDOM.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
    strong = sorted((s, e) for _, s, e in base)
    reach = list(accumulate((e for _, e in strong), max))
    out = []
    for span in sorted(set(found), key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        k = bisect_left(strong, (span[2],))
        if not k or reach[k - 1] <= span[1]:
            out.append(span)
    return out


def chosen(linked: list[Span]) -> list[Span]:
    """Of the linked parts those clear of each other: the leftmost, then the longest, then a value before other roles."""
    out: list[Span] = []
    for span in sorted(linked, key=lambda x: (x[1], -x[2], x[0] != "value", KINDS.index(x[0]))):
        if not out or span[1] >= out[-1][2]:
            out.append(span)
    return out


def parsed(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row (a number that tells rows apart), doc_id, base counts and digest, base and weak: the spans of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text=2):
            texts = [x or "" for x in part.column(2).to_pylist()]
            base = [base_spans(x) for x in texts]
            weak = [weak_parts(x, b) for x, b in zip(texts, base)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE]
            lists = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], SPANS) for found in (base, weak)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *counts, pa.array([digest(b, BASE) for b in base]), *lists], names=["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    schema = f"row long, doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base {spans}, weak {spans}"
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(row.alias("row"), "doc_id", "text").mapInArrow(run, schema)


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, links): the weak parts with a complement within scope, by interval join."""
    weak = rows.select("row", F.explode("weak").alias("s")).select("row", "s.*")
    strong = rows.select("row", F.explode("base").alias("s")).select("row", "s.*")
    secret = F.col("kind").isin("value", "assign", "hex")
    # Only documents with a weak part can gain anything.
    parts = weak.unionByName(strong.join(weak.select("row").distinct(), "row", "left_semi")).withColumn("secret", secret)
    cells = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    near = parts.select(F.col("row").alias("row2"), F.col("secret").alias("secret2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.explode(cells).alias("cell2"))
    own_cells = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    each = weak.withColumn("secret", secret).withColumn("cell", F.explode(own_cells))
    clear = (F.col("start2") >= F.col("end")) | (F.col("end2") <= F.col("start"))
    meets = (F.col("row") == F.col("row2")) & (F.col("cell") == F.col("cell2")) & (F.col("secret") != F.col("secret2")) & clear & (F.col("start2") <= F.col("end") + scope) & (F.col("end2") >= F.col("start") - scope)
    found = each.join(near, meets, "left_semi")
    # A part may be found in several of its cells.
    sets = found.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [chosen([(x["kind"], x["start"], x["end"]) for x in links]) for links in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in lists], SPANS)], names=["row", "links"])

    return sets.mapInArrow(run, "row long, links array<struct<kind:string,start:int,end:int>>")


def scan(docs: DataFrame, scope: int = SCOPE, row: Column | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found, row for every row; found is spans as an array."""
    rows = staged(parsed(docs, row), "secrets")
    all_rows = rows.join(linked(rows, scope), "row", "left")
    spans = F.when(F.col("links").isNull(), F.col("base")).otherwise(F.concat("base", "links"))
    placed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return all_rows.withColumn("found", placed).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), "found", "row")


def redacted(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows with every found span replaced by its kind in angle brackets; other columns unchanged."""
    names = docs.columns
    rows, key = numbered(docs, "_secret_row")
    at = names.index("text")
    there, spans_name = free_name(rows, "_found_row"), free_name(rows, "_found_spans")
    found = scan(rows, scope, F.col(key)).where("size(found) > 0").select(F.col("row").alias(there), F.col("found").alias(spans_name))
    joined = rows.join(found.hint("shuffle_hash"), F.col(key) == F.col(there), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                texts.append(x if not spans else replaced(x, [(s["kind"], s["start"], s["end"]) for s in spans]))
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    return joined.select(*[f"`{c}`" for c in names], spans_name).mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
