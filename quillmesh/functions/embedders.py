"""Embedding functions that need no model: texts in, one vector for each out (SRC16, X1). Any function of this form can stand in their place."""

from __future__ import annotations

import hashlib
import math
import re

_PART = re.compile(r"[a-z0-9]+|[^\W_]")


def hashed(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """Hashed counts of words and characters, of unit length; a text without any gets the first axis."""
    out = []
    for text in texts:
        v = [0.0] * dimensions
        for part in _PART.findall((text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "replace"), digest_size=8).digest(), "big")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        length = math.sqrt(sum(x * x for x in v))
        out.append([x / length for x in v] if length else [1.0] + [0.0] * (dimensions - 1))
    return out
