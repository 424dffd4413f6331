"""Encoding texts to pieces of a fixed vocabulary and back: a batched Viterbi search with numpy.

Distinct words of equal length advance together. At each position the hashes of the substrings that end there probe the sorted piece
keys; the largest score over the piece lengths stays, and its length is the back pointer. Characters that no piece covers cost more than
any piece and come out as their UTF-8 bytes, so decoding gives back every text exactly. Of equal scores the longest last piece wins.

A text starts with a space mark, as the vocabulary's own encoder has it; an empty text has no pieces. Words are cut nowhere, texts are
read whole; a word longer than LONG is searched by itself, over the places where pieces match.

Decoding puts the bytes of pieces in a row: `decode_documents` gives texts of any lists of ids, `encode_documents` has the digest of that.

Cases: a null text counts as empty, as does a null list of ids, and a null among ids as no piece; literal space marks are coded by their
bytes; ids that the vocabulary lacks and control pieces stand for no bytes, bytes that are no UTF-8 for the replacement character; one row out
for each row in; an input's columns are kept whatever their names, but for those that are made here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row, with_row
from .pieces import MODEL, OWN_SPACE, SPACE, Vocabulary, batches_of, by_length, code_points, distinct_words, hashed, prefixes, ragged, split_words, vocabulary

LONG = 96
#: What an uncovered character costs beyond the worst piece.
PENALTY = 10.0


def best_pieces(chars: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Of words of equal length: pieces (id, or -1 - code point for an uncovered character), flat, and how many each word has."""
    m, n = chars.shape
    sums = prefixes(chars)
    unknown = float(vocab.scores[vocab.usable].min()) - PENALTY
    best = np.full((m, n + 1), -np.inf)
    best[:, 0] = 0.0
    size, piece = np.zeros((m, n + 1), np.int32), np.zeros((m, n + 1), np.int32)
    for e in range(1, n + 1):
        top, length, last = best[:, e - 1] + unknown, np.ones(m, np.int32), -1 - chars[:, e - 1].astype(np.int32)
        for k in range(1, min(e, vocab.longest) + 1):
            rows, found = vocab.find(hashed(sums, e - k, e))
            if len(rows):
                score = best[rows, e - k] + vocab.scores[found]
                better = score >= top[rows]
                rows = rows[better]
                top[rows], length[rows], last[rows] = score[better], k, found[better]
        best[:, e], size[:, e], piece[:, e] = top, length, last
    return _traced(size, piece)


def _traced(size: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, n = size.shape[0], size.shape[1] - 1
    out, at, steps = np.zeros((m, n), np.int32), np.full(m, n), np.zeros(m, np.int64)
    live = np.arange(m)
    while len(live):
        p = at[live]
        out[live, n - 1 - steps[live]] = piece[live, p]
        steps[live] += 1
        at[live] = p - size[live, p]
        live = live[at[live] > 0]
    return out[np.arange(n)[None, :] >= (n - steps)[:, None]], steps


def best_pieces_long(chars: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The same for one long word: first all matches by piece length at once, in tiles, then one walk over the places."""
    n = len(chars)
    tile = 1 << 16
    hits: list[tuple[int, np.ndarray, np.ndarray]] = []
    for s in range(0, n, tile):
        part = chars[s : s + tile + vocab.longest]
        for k in range(1, min(len(part), vocab.longest) + 1):
            windows = np.lib.stride_tricks.sliding_window_view(part, k)[:tile]
            rows, found = vocab.find(hashed(prefixes(windows), 0, k))
            hits.append((k, rows + s + k, found))
    ends, sizes, ids = np.concatenate([h[1] for h in hits]), np.concatenate([np.full(len(h[1]), h[0]) for h in hits]), np.concatenate([h[2] for h in hits])
    order = np.lexsort((sizes, ends))
    ends, sizes, ids = ends[order], sizes[order], ids[order]
    cut = np.searchsorted(ends, np.arange(n + 2)).tolist()
    sizes, ids, scores = sizes.tolist(), ids.tolist(), vocab.scores[ids].tolist()
    unknown = float(vocab.scores[vocab.usable].min()) - PENALTY
    best, back, last = [0.0] * (n + 1), [1] * (n + 1), [0] * (n + 1)
    points = chars.astype(np.int64).tolist()
    for e in range(1, n + 1):
        top, length, piece = best[e - 1] + unknown, 1, -1 - points[e - 1]
        for h in range(cut[e], cut[e + 1]):
            score = best[e - sizes[h]] + scores[h]
            if score >= top:
                top, length, piece = score, sizes[h], ids[h]
        best[e], back[e], last[e] = top, length, piece
    out, e = [], n
    while e:
        out.append(last[e])
        e -= back[e]
    return np.array(out[::-1], np.int32)


def with_bytes(pieces: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Uncovered characters as the pieces of their bytes; and the new counts."""
    if not (pieces < 0).any():
        return pieces, counts
    byte_piece = np.zeros(256, np.int32)
    known = np.flatnonzero(vocab.byte_of >= 0)
    byte_piece[vocab.byte_of[known]] = known
    missing = np.flatnonzero(pieces < 0)
    points = -1 - pieces[missing].astype(np.int64)
    values, which = np.unique(points, return_inverse=True)
    coded = [chr(SPACE if v == OWN_SPACE else v).encode("utf-8", "surrogatepass") for v in values.tolist()]
    sizes = np.array([len(c) for c in coded], np.int64)
    flat = byte_piece[np.frombuffer(b"".join(coded), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    width = np.ones(len(pieces), np.int64)
    width[missing] = sizes[which]
    out = np.repeat(pieces, width)
    place = (np.cumsum(width) - width)[missing]
    out[ragged(place, sizes[which])] = flat[ragged(starts[which], sizes[which])]
    owner = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(owner, width, len(counts)).astype(np.int64)


def encode(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of texts, one after the other, and the n + 1 offsets."""
    chars, at = code_points(texts)
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    lo, hi = split_words(chars, at)
    _, first, which = distinct_words(chars, lo, hi)
    starts, ends = lo[first], hi[first]
    flat, owner, counts = [], [], np.zeros(len(first), np.int64)
    for n, group in by_length(starts, ends):
        if n > LONG:
            for w in group:
                ids, count = with_bytes(*((x := best_pieces_long(chars[starts[w] : ends[w]], vocab)), np.array([len(x)])), vocab)
                flat.append(ids)
                owner.append(np.array([w]))
                counts[w] = count[0]
            continue
        ids, count = with_bytes(*best_pieces(chars[starts[group][:, None] + np.arange(n)], vocab), vocab)
        flat.append(ids)
        owner.append(group)
        counts[group] = count
    order = np.concatenate(owner)
    begin = np.zeros(len(first), np.int64)
    begin[order] = np.cumsum(counts[order]) - counts[order]
    ids = np.concatenate(flat)[ragged(begin[which], counts[which])]
    ends_of_words = np.r_[0, np.cumsum(counts[which])]
    return ids, ends_of_words[np.searchsorted(lo, at)]


def decode(ids: np.ndarray, at: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """UTF-8 texts of runs of piece ids, without the leading space."""
    data, offsets = vocab.bytes_of()
    size = np.diff(offsets)[ids]
    out = data[ragged(offsets[ids], size)].tobytes()
    cut = np.r_[0, np.cumsum(size)][at].tolist()
    return [out[lo + out.startswith(b" ", lo, hi) : hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def _coded(path: str):
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            counts, flat, digests, same = [], [], [], []
            for _, texts in batches_of(batch.column(1)):
                ids, at = encode(texts, vocab)
                back = decode(ids, at, vocab)
                flat.append(ids)
                counts.append(np.diff(at))
                digests += [hashlib.sha256(b).hexdigest() for b in back]
                same += [b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, texts, strict=True)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(n), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["row", "piece_ids", "n_pieces", "decoded_sha256", "round_trip"])

    return run


def encode_documents(docs: DataFrame, path: str = MODEL, text: str = "text") -> DataFrame:
    """docs without the text, with piece_ids, n_pieces, the digest of what they decode to, and whether that is the text."""
    made = ["piece_ids", "n_pieces", "decoded_sha256", "round_trip"]
    rows = docs.select(whole_row(docs, *made, text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(_coded(path), with_row(rows, "piece_ids array<int>, n_pieces bigint, decoded_sha256 string, round_trip boolean")).select("row.*", *made)


def _decoded(path: str):
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (ids >= 0) & (ids < len(vocab.pieces))
            at = np.r_[0, np.cumsum(known)][np.r_[0, np.cumsum(size)]]
            texts = [b.decode("utf-8", "replace") for b in decode(ids[known], at, vocab)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return run


def decode_documents(coded: DataFrame, path: str = MODEL, pieces: str = "piece_ids") -> DataFrame:
    """coded without the piece ids, with the text that they stand for; a column of that name is replaced."""
    rows = coded.select(whole_row(coded, pieces, "text").alias("row"), F.col(pieces).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(path), with_row(rows, "text string")).select("row.*", "text")
