"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

MIX = np.uint32(2654435761)
STEP = np.uint32(16777619)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each text begins (and the last ends)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def hashed(codes: np.ndarray, sizes: range, bits: int):
    """For each n in ``sizes``: n and the bucket of the n-gram that begins at each position but the last n - 1."""
    h = codes.astype(np.uint32) * MIX
    shift = np.uint32(32 - bits)
    for n in range(1, sizes.stop):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * STEP + codes[n - 1 :] * MIX if len(h) > 1 else h[:0]
        if n in sizes:
            mixed = (h ^ (h >> np.uint32(13)) ^ np.uint32(n)) * MIX
            yield n, mixed >> shift
