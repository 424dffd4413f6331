"""Words and word shingles of many texts at once, as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np

from .fingerprints64 import M2, M3, SLICE, mix, powers

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A number for each byte value, so that the hash of a word is no small number.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * M3)


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Of texts that lie one after the other, parted by their starts and ends: first and last byte + 1, text and hash of each word."""
    base = int(starts[0])
    buf = data[base : int(ends[-1])]
    solid = ~SPACES[buf]
    open_ = solid.copy()
    open_[1:] &= ~solid[:-1]
    cuts = (starts - base)[(starts - base) < len(buf)]
    open_[cuts] = solid[cuts]  # a word ends with its text
    lo = np.flatnonzero(open_)
    closed = np.zeros(len(buf) + 1, bool)
    closed[1:] = solid
    closed[1:-1] &= ~solid[1:] | open_[1:]
    hi = np.flatnonzero(closed)
    h = _hashes(buf, lo, hi)
    text = np.searchsorted(ends - base, lo, side="right")
    return lo, hi, text, h


def _hashes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each stretch of bytes. Exponents start anew every SLICE bytes; a stretch across such a place is summed by itself."""
    up, down = powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        for s in range(0, len(buf), SLICE):
            part = buf[s : s + SLICE]
            np.cumsum(BYTE[part] * up[: len(part)], out=sums[s + 1 : s + 1 + len(part)])
            sums[s + 1 : s + 1 + len(part)] += sums[s]
        h = (sums[hi] - sums[lo]) * down[lo % SLICE]
        for w in np.flatnonzero(lo // SLICE != (hi - 1) // SLICE):
            part, total, step = BYTE[buf[lo[w] : hi[w]]], np.uint64(0), np.uint64(1)
            for s in range(0, len(part), SLICE):
                piece = part[s : s + SLICE]
                total = total + (piece * up[: len(piece)]).sum(dtype=np.uint64) * step
                step = step * up[SLICE]
            h[w] = total
        return mix(h + (hi - lo).astype(np.uint64))


def shingles(text: np.ndarray, h: np.ndarray, texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """text and hash of each run of n words; a text of fewer words has one run of all its words."""
    count = np.bincount(text, minlength=texts)
    first = np.cumsum(count) - count
    at = np.arange(len(text)) - first[text]
    size = np.minimum(n, count)[text]
    whole = at + size <= count[text]
    whole &= (count[text] >= n) | (at == 0)
    lead = np.flatnonzero(whole)
    with np.errstate(over="ignore"):
        out = np.zeros(len(lead), np.uint64)
        for j in range(n):
            inside = size[lead] > j
            out = (out + np.where(inside, h[np.minimum(lead + j, len(h) - 1)] if len(h) else 0, np.uint64(0))) * M2
        return text[lead], mix(out + size[lead].astype(np.uint64))


def distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text and hash of the distinct shingles, sorted by both, and how often each comes."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.r_[first, len(h)])
