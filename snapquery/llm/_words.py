"""Words of many texts at once, as byte ranges with 64-bit hashes, in numpy.

Both word classes used here are classes of ASCII characters (all others are word characters, or none
matters), so they can be told apart byte by byte in UTF-8.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Multipliers of the published splitmix64 generator, and an odd base for rolling sums.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15

#: A-Z to a-z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SAME = bytes(range(256))
#: Letters, digits and everything beyond ASCII.
ALNUM = np.array([c >= 128 or chr(c).isalnum() and not chr(c).isupper() for c in range(256)])
#: All but white space.
VISIBLE = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


@cache
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    both = []
    for base in (BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    size = 1 << max(12, int(n).bit_length())
    if size <= 1 << 20:
        return _powers(size)
    return _powers.__wrapped__(size)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive values of ``h``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(h) - n + 1, np.uint64)
    step = 1 << 16
    for at in range(0, len(out), step):
        part = h[at : at + step + n - 1]
        up, down = powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
        out[at : at + step] = mix((sums[n:] - sums[:-n]) * down[: len(part) - n + 1])
    return out


@dataclass
class Words:
    """The words of some texts in order: ranges in ``data``, the index of the text, a hash; ``first`` has each text's first word."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def joined(self, i: int, n: int) -> bytes:
        """Words i to i + n - 1, joined by a space."""
        d = self.data
        return b" ".join([d[s:e] for s, e in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist(), strict=True)])


def find_words(texts: list[bytes], kind: np.ndarray, fold: bytes = SAME) -> Words:
    """The maximal runs of bytes of ``kind`` in each text, after ``fold``."""
    data = b" ".join(texts).translate(fold)
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], kind[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, begins)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    h = np.empty(len(start), np.uint64)
    values, at = byte_values(), 0
    while at < len(start):  # in blocks that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 16), "right")))
        lo, hi = int(start[at]), int(end[to - 1])
        up, down = powers(hi - lo + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw[lo:hi]] * up[: hi - lo])])
        h[at:to] = mix((sums[end[at:to] - lo] - sums[start[at:to] - lo]) * down[start[at:to] - lo])
        at = to
    return Words(data, start, end, text, first, h)
