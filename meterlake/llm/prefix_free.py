"""Prefix-free parsing: the order of all places of some texts, from the suffix array of a dictionary and that of a parse.

Triggers are the places whose rolling hash (of TRIGGER bytes) is divisible by a number. They cut each text into phrases; a phrase ends with
the trigger string that the next one starts with, so no phrase is the start of another. The dictionary has each distinct phrase once, the
parse has each text as phrase numbers. A place of a text is a place in a phrase (the dictionary's suffix from there, its rank) and what
follows (the parse's suffix after it, its rank): sorting by both is sorting the texts' suffixes, while bytes are compared in the dictionary
alone. For repetitive texts that is far smaller than they are.

Ranks come from prefix doubling with numpy and are cut off at `width` bytes, so places get equal ranks if the next `width` bytes agree and
nothing more is asked. Everything is exact: equal hashes are verified by bytes.
"""

from __future__ import annotations

import numpy as np

from .fingerprints64 import BYTES, Rolling
from .pieces import ragged

#: Bytes of a trigger, the word that the rolling hash covers.
TRIGGER = BYTES
#: One place in so many is a trigger.
DIVISOR = 40
#: Bytes, as digits from 1 (0: the end), that fit one number.
DIGITS = 7


def is_trigger(roll: Rolling, divisor: int = DIVISOR) -> np.ndarray:
    return roll.at % np.uint64(divisor) == 0


class Parse:
    """texts one after the other (data, starts, ends), cut into phrases."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, divisor: int = DIVISOR):
        cut = np.zeros(len(data) + 1, bool)
        roll = Rolling(data)
        cut[: len(roll.at)] = is_trigger(roll, divisor)
        for k in range(1, TRIGGER):  # a trigger string lies within its text
            cut[np.maximum(ends - k, 0)] = False
        cut[starts] = True
        cut[-1] = False
        self.data = data
        self.first = np.flatnonzero(cut)
        self.text = np.searchsorted(starts, self.first, side="right") - 1
        last = np.r_[self.text[1:] != self.text[:-1], True] if len(self.first) else np.zeros(0, bool)
        self.end = np.where(last, ends[self.text], np.minimum(np.r_[self.first[1:], 0] + TRIGGER, ends[self.text]))
        self.last = last
        self._distinct()

    def _distinct(self) -> None:
        """Phrases' numbers in the dictionary, and where the dictionary's phrases lie in the data."""
        size = self.end - self.first
        h = np.zeros(len(size), np.uint64)
        roll = Rolling(self.data)
        whole = size >= TRIGGER
        h[whole] = roll.of(self.first[whole], self.end[whole])
        for n in range(1, TRIGGER):  # short ends of texts, as numbers
            at = self.first[size == n]
            if len(at):
                h[size == n] = sum(self.data[at + i].astype(np.uint64) << np.uint64(8 * i) for i in range(n))
        order = np.lexsort((h, size))
        new = np.ones(len(order), bool)
        new[1:] = (size[order][1:] != size[order][:-1]) | (h[order][1:] != h[order][:-1])
        lead = order[np.flatnonzero(new)]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        mine, first = ragged(self.first, size), ragged(self.first[lead][self.number], size)
        if (self.data[mine] != self.data[first]).any():
            raise ArithmeticError("two phrases share a hash")
        self.lead, self.size = self.first[lead], size[lead]


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of the values."""
    return np.unique(key, return_inverse=True)[1].reshape(key.shape) + 1


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ranks(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b)


def dictionary_ranks(parse: Parse, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each dictionary phrase begins among the dictionary's places, and the ranks of its suffixes by their first `width` bytes."""
    size = parse.size
    at = np.cumsum(size) - size
    n = int(size.sum())
    left = np.repeat(at + size, size) - np.arange(n)  # bytes up to the phrase's end
    digit = parse.data[ragged(parse.lead, size)].astype(np.int64) + 1

    def beyond(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if k < n:
            out[: n - k] = np.where(left[: n - k] > k, x[k:], 0)
        return out

    key, span = digit.copy(), 1
    while span < min(DIGITS, width):
        key = key * 257 + beyond(digit, span)
        span += 1
    rank = _ranks(key)
    while span < width:  # ranks of `span` bytes make those of up to twice as many
        step = min(span, width - span)
        rank = _paired(rank, beyond(rank, step))
        span += step
    return at, rank


def parse_ranks(parse: Parse, rank_of: np.ndarray) -> np.ndarray:
    """Ranks of the parse's suffixes, from the ranks of the phrases; a text's end comes before all else."""
    n = len(parse.first)
    final = np.flatnonzero(parse.last)
    left = final[np.searchsorted(final, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)
    rank, span = _ranks(rank_of[parse.number]), 1
    while span < int(left.max(initial=1)):
        after = np.zeros(n, np.int64)
        after[: max(0, n - span)] = np.where(left[: max(0, n - span)] > span, rank[span:], 0)
        rank = _paired(rank, after)
        span *= 2
    return rank


class Lowest:
    """The smallest of any stretch of an array, from a table of stretches of 1, 2, 4, ... elements."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of lo .. hi - 1, with lo < hi."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.levels[k][lo[m]], self.levels[k][hi[m] - (1 << k)])
        return out


def _shared(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, most: int) -> np.ndarray:
    """How many bytes from the places a and b on agree, up to `most`."""
    size = np.minimum(np.minimum(a_end - a, b_end - b), most)
    out = size.copy()
    live = np.flatnonzero(size > 0)
    step, done = 16, 0
    while len(live):
        k = np.arange(done, min(done + step, most))
        inside = k[None, :] < size[live][:, None]
        far = len(data) - 1
        differs = (data[np.minimum(a[live][:, None] + k, far)] != data[np.minimum(b[live][:, None] + k, far)]) & inside
        hit = differs.any(1)
        out[live[hit]] = done + differs[hit].argmax(1)
        done += len(k)
        live = live[~hit & (size[live] > done)]
    return out


def corpus_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, width: int, divisor: int = DIVISOR) -> tuple[np.ndarray, np.ndarray]:
    """The order of places (of the data, each with `width` bytes of its text from there) by what follows, and whether each in that order
    agrees with the one before it in `width` bytes."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    parse = Parse(data, starts, ends, divisor)
    at, rank = dictionary_ranks(parse, width)
    follow = parse_ranks(parse, rank[at])
    # neighbours in the parse's order, with the bytes that they share
    by_follow = np.argsort(follow, kind="stable")
    spot = np.empty(len(by_follow), np.int64)
    spot[by_follow] = np.arange(len(by_follow))
    shared = np.zeros(len(by_follow), np.int64)
    a, b = by_follow[:-1], by_follow[1:]
    shared[1:] = _shared(data, parse.first[a], ends[parse.text[a]], parse.first[b], ends[parse.text[b]], width)
    low = Lowest(shared)

    phrase = np.searchsorted(parse.first, places, side="right") - 1
    alpha = rank[at[parse.number[phrase]] + places - parse.first[phrase]]
    rest = parse.end[phrase] - places  # bytes of the phrase from the place on
    long = rest >= width
    after = np.where(long, -1, spot[np.minimum(phrase + 1, len(spot) - 1)])
    order = np.lexsort((after, alpha))
    same = np.zeros(len(order), bool)
    one, two = order[:-1], order[1:]
    equal = alpha[one] == alpha[two]
    same[1:] = equal & long[two]
    ask = np.flatnonzero(equal & ~long[two])
    lo, hi = after[one[ask]], after[two[ask]]
    enough = np.ones(len(ask), bool)
    differ = lo < hi
    enough[differ] = low.of(lo[differ] + 1, hi[differ] + 1) >= width - (rest[two[ask]][differ] - TRIGGER)
    same[1:][ask] = enough
    return order, same
