"""Vectorised 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and how many words each text has.

    Words are cut at spaces and the controls 9 to 13.  A word's hash is a polynomial over its bytes, mixed.
    """
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    inner = ~white
    starts = np.flatnonzero(inner & np.concatenate([[True], white[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(raws), np.int64)
    ends = np.flatnonzero(white & np.concatenate([[False], inner[:-1]]))
    at = np.arange(len(data))
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    longest = int((ends - starts).max())
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _BASE, np.uint64)]), dtype=np.uint64)
    value = np.where(inner, (data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(at, longest)], np.uint64(0))
    hashes = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bounds = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * _BASE + words[i : i + len(out)]
    return mix(out)


def join_hashes(a: np.ndarray, b: np.ndarray, salt: int = 1) -> np.ndarray:
    """Hash of a run from the hashes of its two halves."""
    return mix(mix(a + np.uint64(salt)) * _BASE + b)
