"""Rolling 64-bit hashes of byte buffers with numpy, and fixed-width records packed into Arrow binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# fixed values: odd multipliers of the mixing steps
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BASE = 0xD1342543DE82EF95
SLICE = 1 << 20
BYTES = 8

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x * M1
    x ^= x >> np.uint64(32)
    x *= M2
    x ^= x >> np.uint64(29)
    return x


def powers(most: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for each i of a slice."""
    key = f"{most}"
    if key + "up" not in _powers:
        with np.errstate(over="ignore"):
            for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                out = np.ones(most + 1, np.uint64)
                n, step = 1, np.uint64(b)
                while n < len(out):  # doubling: out[n:2n] = out[:n] * b**n
                    out[n : 2 * n] = out[: len(out[n : 2 * n])] * step
                    n, step = 2 * n, step * step
                _powers[key + name] = out
    return _powers[key + "up"], _powers[key + "down"]


class Rolling:
    """Hashes of any substring of at least eight bytes of a buffer."""

    def __init__(self, buf: np.ndarray, seed: int = 0):
        n = max(0, len(buf) - BYTES + 1)
        with np.errstate(over="ignore"):
            words = np.ndarray((n,), "<u8", np.ascontiguousarray(buf), 0, (1,)) if n else np.zeros(0, np.uint64)
            self.at = mix(words ^ np.uint64(seed))  # of the eight bytes at each position
            up, self.down = powers(max(SLICE, 1 << int(n).bit_length()))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.at * up[:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[hi - (BYTES - 1)] - self.sums[lo]) * self.down[lo]
            h += (hi - lo).astype(np.uint64) * M3
            return mix(h)


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, and the n + 1 offsets into them. Nulls count as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def slices(at: np.ndarray, overlap: int = 0, most: int = SLICE):
    """(first row, rows, starts and ends in the data, offset of the first start in its text) of stretches of at most `most` bytes.

    A longer text comes in tiles of its own, each sharing `overlap` bytes with the next.
    """
    n, i = len(at) - 1, 0
    while i < n:
        if at[i + 1] - at[i] > most:
            lo = int(at[i])
            while True:
                hi = min(lo + most, int(at[i + 1]))
                yield i, 1, np.array([lo]), np.array([hi]), lo - int(at[i])
                if hi == at[i + 1]:
                    break
                lo = hi - overlap
            i += 1
            continue
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        yield i, j - i, at[i:j], at[i + 1 : j + 1], 0
        i = j


def packed(keys: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct keys in order, and for each the bytes of its records."""
    order = np.argsort(keys, kind="stable")
    keys, records = keys[order], np.ascontiguousarray(records[order])
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    offsets = (np.r_[first, len(keys)] * records.dtype.itemsize).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
    return keys[first], blob


def sent(parts: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """(part, blob) batches for a shuffle: a blob holds a part's records field by field, which compresses better than record by record."""
    order = np.argsort(parts, kind="stable")
    parts = parts[order]
    first = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else np.zeros(0, np.int64)
    fields = [np.ascontiguousarray(records[f][order]) for f in records.dtype.names]
    blobs = [b"".join(f[lo:hi].tobytes() for f in fields) for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(parts)], strict=True)] if len(parts) else []
    return pa.RecordBatch.from_arrays([pa.array(parts[first].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])


def sent_texts(parts: np.ndarray, records: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """The same for records that come with a text each, sizes bytes long, one after the other in data: (part, blob, texts)."""
    at = np.cumsum(sizes) - sizes
    order = np.argsort(parts, kind="stable")
    batch = sent(parts, records)
    parts, sizes, at = parts[order], sizes[order], at[order]
    ends = np.cumsum(sizes)
    place = np.repeat(at - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    flat = data[place]
    last = np.flatnonzero(np.r_[parts[1:] != parts[:-1], True]) if len(parts) else np.zeros(0, np.int64)
    cuts = np.r_[0, ends[last]].tolist()
    texts = [flat[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["part", "blob", "texts"])


def received(column, dtype: np.dtype) -> np.ndarray:
    """The records of the blobs made by sent()."""
    blobs = [b.as_py() for b in column]
    counts = [len(b) // dtype.itemsize for b in blobs]
    out = np.empty(sum(counts), dtype)
    at = 0
    for b, n in zip(blobs, counts, strict=True):
        place = 0
        for f in dtype.names:
            out[f][at : at + n] = np.frombuffer(b, dtype[f], n, place)
            place += n * dtype[f].itemsize
        at += n
    return out


def whole_texts(at: np.ndarray, most: int = SLICE):
    """(first row, rows, starts and ends in the data) of stretches of whole texts; one longer than `most` bytes comes by itself."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j - i, at[i:j], at[i + 1 : j + 1]
        i = j
