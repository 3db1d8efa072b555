"""What the two span-finding operators share: digests of spans and their order."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then in the order of kinds, comma-joined."""
    rank = {k: n for n, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(spans: list[Span], kinds: list[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
