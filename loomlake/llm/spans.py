"""Spans of text by kind, in code points, and the digests that queries derive from them."""

from __future__ import annotations

import hashlib


def listed(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the order of ``kinds``, comma-joined."""
    order = {kind: i for i, kind in enumerate(kinds)}
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
