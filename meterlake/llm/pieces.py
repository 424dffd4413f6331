"""A fixed public vocabulary of word pieces, looked up by substring hash, and texts as runs of code points.

A word is a run of spaces and the run of other characters after it; spaces count as the vocabulary's space mark, and a text starts with
one. No piece has a space mark after another character, so no piece crosses words and each distinct word needs to be worked on once.
Distinct words of equal length form one matrix and advance together, position by position.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa

from .fingerprints64 import M1, M2, M3, SLICE, mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: A literal space mark in a text: a code point that no text has, so that it meets no piece.
OWN_SPACE = 0x110001


class Vocabulary:
    """Pieces, their scores, and the byte that a byte piece stands for (-1: none)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_of: list[int], usable: list[bool]):
        self.pieces, self.scores, self.byte_of, self.usable = pieces, np.asarray(scores, float), np.asarray(byte_of), np.asarray(usable)
        self.longest = max((len(p) for p, u in zip(pieces, usable, strict=True) if u), default=1)
        self.key, self.id = _sorted_keys(pieces, usable)
        # the first key of each value of the keys' first bits, -1 where there is none: most substrings are told from pieces by one look
        top = (self.key >> np.uint64(42)).astype(np.int64)
        self.slot = np.full(1 << 22, -1, np.int32)
        self.slot[top[::-1]] = np.arange(len(top))[::-1]
        self.chain = int(np.bincount(top).max()) if len(top) else 0
        self._bytes = None

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and the pieces' ids."""
        at = self.slot[(hashes >> np.uint64(42)).astype(np.int64)]
        rows = np.flatnonzero(at >= 0)
        at, h = at[rows], hashes[rows]
        id_ = np.where(self.key[at] == h, self.id[at], -1) if len(rows) else np.zeros(0, np.int32)
        for step in range(1, self.chain):
            near = np.minimum(at + step, len(self.key) - 1)
            id_ = np.where(self.key[near] == h, self.id[near], id_)
        hit = id_ >= 0
        return (rows, id_) if hit.all() else (rows[hit], id_[hit])

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """What the pieces stand for as bytes, one after the other, and the n + 1 offsets."""
        if self._bytes is not None:
            return self._bytes
        out = [bytes([b]) if b >= 0 else (p.replace(chr(SPACE), " ").encode() if u else b"") for p, b, u in zip(self.pieces, self.byte_of.tolist(), self.usable.tolist(), strict=True)]
        self._bytes = np.frombuffer(b"".join(out), np.uint8), np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int64)
        return self._bytes


@cache
def vocabulary(path: str = MODEL) -> Vocabulary:
    """A sentencepiece model's pieces. Scores of merge ranks (whole numbers) become logarithms by Zipf's law, -log(1 + rank): a sum of
    ranks would take three frequent fragments rather than one word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(len(model))
    pieces = [model.id_to_piece(i) for i in ids]
    scores = [model.get_score(i) for i in ids]
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
    if all(s == int(s) for s in scores):
        first = min(i for i in ids if plain[i])
        scores = [-math.log(1 + (-s if s else i - first)) if plain[i] else 0.0 for i, s in zip(ids, scores, strict=True)]
    byte_of = [int(p[3:5], 16) if model.is_byte(i) else -1 for i, p in zip(ids, pieces, strict=True)]
    return Vocabulary(pieces, scores, byte_of, plain)


def _sorted_keys(pieces: list[str], usable: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([i for i, u in enumerate(usable) if u], np.int32)
    keys = np.zeros(len(ids), np.uint64)
    by_length: dict[int, list[int]] = {}
    for row, i in enumerate(ids):
        by_length.setdefault(len(pieces[i]), []).append(row)
    for n, rows in by_length.items():
        chars = np.frombuffer("".join(pieces[ids[r]] for r in rows).encode("utf-32-le"), np.uint32).reshape(-1, n)
        keys[rows] = hashed(prefixes(chars), 0, n)
    order = np.argsort(keys)
    return keys[order], ids[order]


def prefixes(chars: np.ndarray) -> np.ndarray:
    """Of words of equal length, a row each: sums from which any substring's hash follows."""
    n = chars.shape[1]
    up, _ = powers(_reach(n))
    with np.errstate(over="ignore"):
        sums = np.zeros((len(chars), n + 1), np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) * M3 + M1) * up[:n], axis=1, out=sums[:, 1:])
    return sums


def _reach(n: int) -> int:
    return max(SLICE, 1 << int(n).bit_length())


def hashed(sums: np.ndarray, lo: int, hi: int) -> np.ndarray:
    _, down = powers(_reach(sums.shape[1]))
    with np.errstate(over="ignore"):
        return mix((sums[:, hi] - sums[:, lo]) * down[lo] + np.uint64(hi - lo) * M2)


def hashed_all(sums: np.ndarray, k: int) -> np.ndarray:
    """Of all substrings of k characters: words x places."""
    _, down = powers(_reach(sums.shape[1]))
    with np.errstate(over="ignore"):
        return mix((sums[:, k:] - sums[:, :-k]) * down[: sums.shape[1] - k] + np.uint64(k) * M2)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, a leading space each (none for an empty text), with space marks; and the n + 1 offsets."""
    joined = "".join(" " + t if t else "" for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    out = np.where(raw == SPACE, np.uint32(OWN_SPACE), raw)
    return np.where(raw == 0x20, np.uint32(SPACE), out), np.r_[0, np.cumsum(lengths)]


def split_words(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each word: a word starts where spaces do, and with its text."""
    space = chars == SPACE
    new = space.copy()
    new[1:] &= ~space[:-1]
    new[at[:-1][at[:-1] < len(chars)]] = True
    lo = np.flatnonzero(new)
    return lo, np.r_[lo[1:], len(chars)]


def distinct_words(chars: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct word, the place of one of its occurrences, and for each word which distinct one it is."""
    up, down = powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(chars) + 1, np.uint64)
        step = len(up) - 1
        for s in range(0, len(chars), step):  # powers start anew; longer buffers than a slice have one word across at most
            part = chars[s : s + step].astype(np.uint64)
            sums[s + 1 : s + 1 + len(part)] = sums[s] + np.cumsum(mix(part * M3 + M1) * up[: len(part)])
        h = mix((sums[hi] - sums[lo]) * down[lo % step] + (hi - lo).astype(np.uint64) * M2)
    return np.unique(h, return_index=True, return_inverse=True)


def by_length(lo: np.ndarray, hi: np.ndarray, most: int = 1 << 19):
    """(length, indices) of words of equal length, in groups of bounded size."""
    length = hi - lo
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            n = int(length[group[0]])
            step = max(1, most // n)
            for i in range(0, len(group), step):
                yield n, group[i : i + step]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def batches_of(column: pa.Array, most: int = 1 << 21):
    """(first row, texts) of stretches of about `most` characters; a longer text stands alone. Nulls are empty texts."""
    held, size, first = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        t = t or ""
        if held and size + len(t) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held
