"""Word shingles of whole texts as sorted distinct 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * _B
    x = (x ^ x >> np.uint64(27)) * _C
    return x ^ x >> np.uint64(31)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles of a text, in order."""
    out = np.sort(shingles(text, width))
    new = out[1:] != out[:-1]  # np.unique takes six times as long
    return out if new.all() else out[np.concatenate([[True], new])]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Shingles of ``width`` words, A-Z in lower case; fewer words are one shingle, none an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        words = [b" ".join(words)]
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    if n < width:
        return mixed(h ^ np.uint64(n))
    out = h[: n - width + 1]
    for j in range(1, width):
        out = mixed(out * _A + h[j : n - width + 1 + j])
    return out
