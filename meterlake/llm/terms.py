"""Terms of many texts at once, with numpy: runs of ASCII digits and letters and of all signs beyond ASCII, A-Z lower-cased.

No byte of a sign beyond ASCII is an ASCII byte in UTF-8, so bytes decide: `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`.
Texts are never cut: a slice holds whole texts, and a text longer than a slice is a slice by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .fingerprints64 import M3, SLICE, mix, powers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SOLID = np.zeros(256, bool)
for lo, hi in (("0", "9"), ("A", "Z"), ("a", "z")):
    SOLID[ord(lo) : ord(hi) + 1] = True
SOLID[128:] = True
#: A number for each byte value, so that the hash of a term is no small number.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * M3)
#: Longer terms are hashed one by one, so that powers for a slice suffice for the others.
LONG = SLICE // 4
TEXTS = 4 * SLICE


@dataclass
class Terms:
    """buf: lower-cased bytes. lo, hi: where each term begins and ends in it. first: each text's first term, and the number of all."""

    buf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits of each term."""
        out = np.zeros(len(self.lo), np.uint64)
        size = self.hi - self.lo
        up, down = powers()
        edges = np.searchsorted(self.lo, np.arange(0, len(self.buf) + SLICE // 2, SLICE // 2))
        with np.errstate(over="ignore"):
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                lo, n = self.lo[a:b] - self.lo[a], np.where(size[a:b] > LONG, 0, size[a:b])
                part = BYTE[self.buf[self.lo[a] : self.lo[a] + int((lo + n).max())]]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * up[: len(part)], out=sums[1:])
                out[a:b] = mix((sums[lo + n] - sums[lo]) * down[lo] + n.astype(np.uint64))
        for i in np.flatnonzero(size > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(self.buf[self.lo[i] : self.hi[i]], digest_size=8).digest(), "little")
        return out

    def term(self, i: int) -> bytes:
        return self.buf[self.lo[i] : self.hi[i]].tobytes()


def terms(data: np.ndarray, at: np.ndarray) -> Terms:
    """Of texts that lie one after the other; at: their n + 1 offsets."""
    base = int(at[0])
    buf = LOWER[data[base : int(at[-1])]]
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = SOLID[buf]
    open_ = solid[1:-1] & ~solid[:-2]
    shut = solid[1:-1] & ~solid[2:]
    cuts = (at[1:-1] - base)[(at[1:-1] > base) & (at[1:-1] < at[-1])]
    open_[cuts] = solid[1:-1][cuts]  # a term ends with its text
    shut[cuts - 1] = solid[1:-1][cuts - 1]
    lo, hi = np.flatnonzero(open_), np.flatnonzero(shut) + 1
    return Terms(buf, lo, hi, np.searchsorted(lo, at - base))


def whole_texts(at: np.ndarray, most: int = TEXTS) -> Iterator[tuple[int, int]]:
    """(first row, last row + 1) of stretches of whole texts of at most `most` bytes, or of one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


def found(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted, distinct `known`, or -1."""
    if not len(known):
        return np.full(len(hashes), -1)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[place] == hashes, place, -1)


def same_bytes(a: np.ndarray, a_lo: np.ndarray, b: np.ndarray, b_lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of two buffers, of `size` bytes each, are equal."""
    same = np.ones(len(size), bool)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        same[live] &= a[a_lo[live] + k] == b[b_lo[live] + k]
        k += 1
        live = live[same[live] & (size[live] > k)]
    return same
