"""Operator 10: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, the
first digit of a run, and words that announce an account. From each anchor a
small deterministic parser walks outwards, finds the boundaries of an e-mail,
network address, card, telephone number, account or URL with user data, and
validates it. Base kinds are what their stated patterns match from left to
right without overlap, failing matches dropped; added kinds never touch them, and a login that would
ends before them.

Defined cases: null text has no spans; rows repeat as they come; positions are
code points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from geoweft.llm.common import text_slices
from geoweft.llm.spans import Span, digest, joined

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "account", "login"]
#: Schemes, and words before an account number; the search for them ignores the case of A-Z.
SCHEMES = ["http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "mongodb://"]
CUES = ["account", "acct", "konto", "compte", "cuenta", "iban", "passport", "ssn"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id))?\x20?[:#=]?\x20?([0-9](?:[\x20-]?[0-9]){5,33})(?![0-9A-Za-z])", re.IGNORECASE | re.ASCII)
IBAN = re.compile(r"\x20?[:#=]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![0-9A-Za-z])")
LOGIN = re.compile(r"[^\s/:@?#]+(?::[^\s/@?#]*)?@[A-Za-z0-9.-]+")
DIGITS = "0123456789"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in ["@", "+", *DIGITS, *SCHEMES, *CUES]:
        found.add_word(x, x)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for n, x in enumerate(reversed(digits)):
        v = int(x) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def ascii_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else, so places stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of one text."""
    base: list[Span] = []
    added: list[Span] = []
    past = {"email": 0, "ip": 0, "card": 0, "phone": 0}
    run = -1  # end of the digit run under way
    cues: list[tuple[str, int]] = []
    for last, anchor in automaton().iter(lowered(text)):
        if anchor == "@":
            low = last
            while low > past["email"] and text[low - 1] in LOCAL:
                low -= 1
            if low < last and (m := DOMAIN.match(text, last + 1)):
                base.append(("email", low, m.end()))
                past["email"] = m.end()
        elif anchor == "+":
            if last >= past["phone"] and (m := PHONE.match(text, last)):
                past["phone"] = m.end()
                if 9 <= len(ascii_digits(m[0])) <= 15:
                    base.append(("phone", last, m.end()))
        elif anchor in DIGITS:
            if last == run:  # not the first digit of its run
                run = last + 1
                continue
            run = last + 1
            for kind, pattern in (("ip", IP), ("card", CARD)):
                at = past[kind] if last < past[kind] else last
                if at == last and (m := pattern.match(text, at)):
                    past[kind] = m.end()
                    if kind == "ip" and all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        base.append((kind, at, m.end()))
                    elif kind == "card" and 12 <= len(d := ascii_digits(m[0])) <= 19 and luhn(d):
                        base.append((kind, at, m.end()))
        else:
            cues.append((anchor, last + 1))
    for anchor, at in cues:
        if anchor.endswith("://"):
            if m := LOGIN.match(text, at):
                added.append(("login", at, m.start() + m[0].rindex("@")))
        elif anchor == "iban" and (m := IBAN.match(text, at)) and iban_valid(m[1]):
            added.append(("iban", *m.span(1)))
        elif m := NUMBER.match(text, at):
            added.append(("account", *m.span(1)))
    # Base spans stay as they are; of the others, those clear of them and of each other.
    clear: list[Span] = []
    taken: list[tuple[int, int]] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for span in sorted({_before_base(text, x, taken) for x in added}, key=lambda x: (x[1], -x[2])):
        if span[1] < span[2] and (not clear or span[1] >= clear[-1][2]) and not _touches(taken, span):
            clear.append(span)
    return base, clear


def _before_base(text: str, span: Span, taken: list[tuple[int, int]]) -> Span:
    """A login whose password and host read as an e-mail ends before that: its user name stays reported."""
    kind, start, end = span
    at = bisect_left(taken, (start,))
    if kind != "login" or at == len(taken) or taken[at][0] >= end:
        return span
    return kind, start, max(start, taken[at][0] - (text[taken[at][0] - 1] == ":"))


def _touches(taken: list[tuple[int, int]], span: Span) -> bool:
    """taken: disjoint intervals in order."""
    at = bisect_left(taken, (span[2],))
    return at > 0 and span[1] < taken[at - 1][1]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [find(x or "") for x in part.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
            shas = pa.array([digest(base, BASE) for base, _ in found])
            spans = pa.array([joined(base + more, KINDS) for base, more in found])
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, shas, spans], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    base, more = find(text)
    out, at = [], 0
    for kind, s, e in sorted(base + more, key=lambda x: (x[1], -x[2])):
        if e > at:
            out += [text[at : max(at, s)], f"<{kind}>"]
            at = e
    return "".join([*out, text[at:]])
