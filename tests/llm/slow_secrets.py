"""Operator 9 by its description, over one text, with nothing of the module but its stated patterns written out again."""

import re

KINDS = ["assign", "access", "hex", "ident", "endpoint", "value"]
IDENT = r"""(?i)(?:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
VALUE = r"""(?i)(?:pwd|pass(?:phrase)?|key|auth|credentials?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
URL = r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+"""
HOST = r"(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+:[0-9]{2,5}\b"


def parts(text, base):
    found = {("ident", *m.span(1)) for m in re.finditer(IDENT, text, re.ASCII)}
    urls = [m.span() for m in re.finditer(URL, text)]
    found |= {("endpoint", *x) for x in urls}
    found |= {("endpoint", *m.span()) for m in re.finditer(HOST, text, re.ASCII) if not any(s < m.end() and m.start() < e for s, e in urls)}
    found |= {("value", *m.span(1)) for m in re.finditer(VALUE, text, re.ASCII)}
    if found or base:
        found |= {("value", *m.span()) for m in re.finditer(RANDOM, text) if all(re.search(x, m[0]) for x in ("[A-Z]", "[a-z]", "[0-9]"))}
    return {x for x in found if not any(s < x[2] and x[1] < e for _, s, e in base)}


def linked(text, base, scope=200):
    """The parts with a complement at most scope away and clear of them; then the leftmost, longest, values first, until none is clear of the chosen."""
    weak = parts(text, base)
    secret = lambda x: x[0] in ("value", "assign", "hex")
    apart = lambda a, b: max(a[1] - b[2], b[1] - a[2])
    left = [a for a in weak if any(secret(a) != secret(b) and 0 <= apart(a, b) <= scope for b in [*weak, *base])]
    out = []
    while left:
        first = min(left, key=lambda x: (x[1], x[1] - x[2], x[0] != "value", KINDS.index(x[0])))
        out.append(first)
        left = [x for x in left if x[1] >= first[2]]
    return out


def spans(text, base):
    found = sorted([*base, *linked(text, base)], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redacted(text, base):
    """Every found span as its kind; of overlapping ones the first, of one start the longest, and nothing of the others is left."""
    found = sorted([*base, *linked(text, base)], key=lambda x: (x[1], -x[2]))
    gone = set()
    marks = {}
    past = 0
    for kind, s, e in found:
        if s >= past:
            marks[s] = f"<{kind}>"
        gone |= set(range(s, e))
        past = max(past, e)
    return "".join(marks.get(i, "") + ("" if i in gone else c) for i, c in enumerate(text))
