"""Hashes of byte strings by numpy: prefix sums of b[i] * p^i modulo 2^64, then mixing."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, U), "q": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("p", _P), ("q", _INV)):
            with np.errstate(over="ignore"):
                steps = np.full(size, U(base))
                steps[0] = U(1)
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Prefix:
    """Hash of any span of one byte string in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, U)
        # a byte alone maps to a pseudo-random number first, which breaks up the polynomial's regular cases
        np.cumsum(_BYTES[data] * p[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U) * U(_P))

    def windows(self, size: int) -> np.ndarray:
        """Of the spans of this size from every start."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without space, tab, LF, VT, FF and CR."""
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, A-Z in lower case.

    With fewer words the whole sequence is the only one; without words there are none.
    """
    data = lower_ascii(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.int64)
    h = Prefix(data).spans(start, end)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, U(size))
    for j in range(size):
        out = mix(out * U(_P) + h[j : len(h) - size + 1 + j])
    return np.unique(out.view(np.int64))
