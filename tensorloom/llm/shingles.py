"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word; A-Z are lower-cased, words end at the six ASCII white-space characters."""
    words = (text or "").encode().translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row, in order; none if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = mixed(out) * _MIX + h[k : len(h) - n + 1 + k]
    return mixed(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle, a text without words none."""
    h = word_hashes(text)
    return np.unique(windows(h, min(n, len(h)))) if len(h) else h


def fingerprint(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(tokens.tobytes()), np.uint64).astype(np.int64))


_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 1), np.uint64)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n hashes in a row at a cost that doesn't grow with n: differences of a running polynomial's sums."""
    global _powers
    if len(h) < n:
        return np.zeros(0, np.uint64)
    if _powers.shape[1] < len(h):
        both = np.full((2, 1 << len(h).bit_length()), 1, np.uint64)
        both[0, 1:], both[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        _powers = np.cumprod(both, axis=1, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers[0, : len(h)], dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * _powers[1, : len(h) - n + 1] + np.uint64(n))
