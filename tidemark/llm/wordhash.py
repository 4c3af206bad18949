"""64-bit hashes of the blank-separated words of a text, for all words at once."""

from __future__ import annotations

import numpy as np

# A-Z in lower case, the six white-space bytes as blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_ROOT), -1, 2**64))
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.full(size, r, dtype=np.uint64)) for r in (_ROOT, _BACK)]
    return _powers[0], _powers[1]


def folded(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").translate(FOLD) if text else b""


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of folded text."""
    letters = np.frombuffer(b" " + data + b" ", dtype=np.uint8) != 32
    edges = np.flatnonzero(letters[1:] != letters[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word of folded text: a polynomial of random letter values, from differences of running sums."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[np.frombuffer(data, dtype=np.uint8)] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])
