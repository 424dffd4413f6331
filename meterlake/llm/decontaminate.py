"""Benchmark decontamination: suffix arrays of the training texts, searched for every suffix of the benchmark's items.

A shard is a slice of a partition's whole texts. Its suffix array orders, by their words, the suffixes that begin in a stretch of at least
`window` words which the items know: a window can begin nowhere else. Ranks double until the longest item is told apart. Every suffix of
every item is found by binary search; its neighbours in the array tell its longest verbatim match and where that lies, and where it is at
least a window long, the suffixes between the bounds of the window are all its occurrences.

Shards need nothing of each other: documents are neither shuffled nor cut, and what they are is decided where they lie. Items come in
blocks of about `BLOCK` words; the documents go through one pass a block, written between passes, so neither the driver nor a task ever holds
more of the benchmark. Items longer than SEGMENT words are searched by overlapping segments, and matches end with a segment.

Null and empty texts have no words and no hits. Items without a word have no window, items of fewer words than `window` are one window as a
whole. Items without an id hit, but are not counted or named; rows with one id are one item. Each row of a repeated document is judged. Extra
columns are carried along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, whole_row, with_row, written
from .fingerprints64 import text_parts
from .terms import Terms, found, same_bytes, terms, whole_texts

WINDOW = 10
BLOCK = 1 << 20
SEGMENT = 4096
BITS = 63
MADE = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


class Index:
    """A block of items: their words as numbers from 1, each segment ended by a 0, and their distinct windows with the items that have them."""

    def __init__(self, segments: list[tuple[str | None, int, bool, str]], window: int):
        """segments: item, its first word's place in the item, whether the segment is a whole item, and the text."""
        segments = sorted(segments, key=lambda s: (s[0] is None, s[0] or "", s[1], s[3]))
        raw = [s[3].encode("utf-8", "surrogatepass") for s in segments]
        at = np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)
        t = terms(np.frombuffer(b"".join(raw), np.uint8), at)
        hashes = t.hashes()
        self.known, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        size = t.hi - t.lo
        if not (size == size[first][number]).all() or not same_bytes(t.buf, t.lo, t.buf, t.lo[first][number], size).all():
            raise ValueError("two words of the items have one hash")
        self.bytes, self.lo, self.size = t.buf, t.lo[first], size[first]
        self.window = window
        self.bits = max(1, int(len(self.known)).bit_length())
        self.per = BITS // self.bits
        count = np.diff(t.first)
        self.words, self.segment, self.place = padded(number + 1, t.first)
        self.keys = keys(self.words, self.bits, self.per)
        self.items = [s[0] for s in segments]
        self.offset = np.array([s[1] for s in segments], np.int64)
        whole = np.array([s[2] for s in segments], bool)
        # windows: of `window` words, or the whole of a shorter item
        length = np.where(whole & (count < window), count, window)
        last = (count - length)[self.segment]
        self.starts = np.flatnonzero((self.words > 0) & (self.place <= last))
        self.length = length[self.segment[self.starts]]
        self.shortest = int(self.length.min()) if len(self.starts) else window
        self.depth = int(count.max()) if len(count) else 0
        cut = [self.length] + [clipped(self.keys, self.starts, d, self.length, self) for d in range(0, window, self.per)]
        _, of = np.unique(np.stack(cut, axis=1), axis=0, return_inverse=True) if len(self.starts) else (None, np.zeros(0, np.int64))
        self.distinct = of.reshape(-1)
        pairs = np.unique(np.stack([self.distinct, self.segment[self.starts]], axis=1), axis=0)
        self.of_window = np.searchsorted(pairs[:, 0], np.arange(int(self.distinct.max(initial=-1)) + 2))
        self.having = pairs[:, 1]


def padded(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a 0 after each text, and each place's text and place in its text."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count + 1)
    begin = first[:-1] + np.arange(len(count))
    place = np.arange(len(text)) - begin[text]
    out = np.zeros(len(text), np.int64)
    out[place < count[text]] = words
    return out, text, place


def keys(words: np.ndarray, bits: int, per: int, where: np.ndarray | None = None) -> np.ndarray:
    """For each place the next `per` words in one number; words after a 0 count as 0."""
    where = np.flatnonzero(words) if where is None else where
    long = np.r_[words, np.zeros(per, np.int64)]
    key, live = np.zeros(len(where), np.int64), np.ones(len(where), bool)
    for k in range(per):
        word = long[where + k]
        live &= word > 0
        key = (key << bits) | np.where(live, word, 0)
    out = np.zeros(len(long), np.int64)
    out[where] = key
    return out


def clipped(all_keys: np.ndarray, start: np.ndarray, d: int, limit: np.ndarray, index: Index) -> np.ndarray:
    """The keys `d` words after each start, of which only words before `limit` count."""
    key = all_keys[np.minimum(start + d, len(all_keys) - 1)]
    over = index.bits * np.clip(index.per - (limit - d), 0, index.per)
    return (key >> over) << over


@dataclass
class Shard:
    """The suffix array of a slice: words as the index numbers them, 0 where it doesn't know them or a text ends."""

    index: Index
    words: np.ndarray
    text: np.ndarray
    place: np.ndarray
    keys: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, t: Terms, index: Index) -> Shard:
        number = found(t.hashes(), index.known)
        # a hash is no proof: words that could be of a window must have the bytes of the word they stand for
        words, text, place = padded(number + 1, t.first)
        zero = np.flatnonzero(words == 0)
        run = np.diff(np.r_[-1, zero]) - 1  # known words before each 0
        good = np.repeat(run >= max(1, index.shortest), run + 1)[: len(words)] & (words > 0)
        where = np.flatnonzero(good)
        term = where - text[where]  # the 0s of earlier texts
        size = t.hi[term] - t.lo[term]
        number = words[where] - 1
        equal = size == index.size[number]
        equal[equal] = same_bytes(t.buf, t.lo[term][equal], index.bytes, index.lo[number][equal], size[equal])
        words[where[~equal]] = 0
        where = where[equal]
        key = keys(np.where(good, words, 0), index.bits, index.per, where)
        return cls(index, words, text, place, key, ordered(key, where, len(words), index))

    def below(self, at: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffix at `at` is below, and whether it is above the item's suffix at `start`, by `limit` words."""
        less, more = np.zeros(len(at), bool), np.zeros(len(at), bool)
        live, d = np.arange(len(at)), 0
        while len(live):
            ours = clipped(self.keys, at[live], d, limit[live], self.index)
            theirs = clipped(self.index.keys, start[live], d, limit[live], self.index)
            less[live], more[live] = ours < theirs, ours > theirs
            d += self.index.per
            full = (theirs & ((1 << self.index.bits) - 1)) > 0
            live = live[(ours == theirs) & full & (limit[live] > d)]
        return less, more

    def bound(self, start: np.ndarray, limit: np.ndarray, above: bool = False) -> np.ndarray:
        """The first place in the array that is not below (or is above) each of the items' suffixes: a binary search for all at once."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.order))
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less, more = self.below(self.order[mid], start[live], limit[live])
            right = ~more if above else less
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def common(self, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many words the suffixes at `at` and the items' suffixes at `start` share."""
        ours, theirs = np.r_[self.words, 0], np.r_[self.index.words, 0]
        n, live = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(live):
            a, b = ours[np.minimum(at[live] + n[live], len(ours) - 1)], theirs[np.minimum(start[live] + n[live], len(theirs) - 1)]
            live = live[(a == b) & (a > 0)]
            n[live] += 1
        return n

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each of the index's suffixes the longest match in this shard and where it begins; 0 and -1 where there is none."""
        start = self.index.starts
        if not len(self.order) or not len(start):
            return np.zeros(len(start), np.int64), np.full(len(start), -1)
        here = self.bound(start, np.full(len(start), 1 << 40))
        sides = [self.order[np.clip(here + k, 0, len(self.order) - 1)] for k in (-1, 0)]
        n = [self.common(at, start) for at in sides]
        size, at = np.where(n[0] >= n[1], n[0], n[1]), np.where(n[0] >= n[1], sides[0], sides[1])
        return size, np.where(size > 0, at, -1)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, its words, where) of each place at which a distinct window of the items occurs."""
        size, _ = self.longest()
        met = np.flatnonzero(size >= self.index.length)
        _, one = np.unique(self.index.distinct[met], return_index=True)
        met = met[one]
        start, limit = self.index.starts[met], self.index.length[met]
        lo, hi = self.bound(start, limit), self.bound(start, limit, above=True)
        n = hi - lo
        which = np.repeat(np.arange(len(met)), n)
        at = self.order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return self.index.distinct[met][which], limit[which], at


def ordered(key: np.ndarray, where: np.ndarray, n: int, index: Index) -> np.ndarray:
    """`where` in the order of the words that follow, up to the depth of the index: by keys, then by ranks that double."""
    order = np.argsort(key[where], kind="stable")
    out = where[order]
    rank = np.zeros(len(key), np.int64)
    new = np.r_[True, key[out][1:] != key[out][:-1]][: len(out)]
    rank[out] = np.maximum.accumulate(np.where(new, np.arange(1, len(out) + 1), 0))
    h = index.per
    while h < index.depth and len(out):
        group = rank[out]
        tied = np.flatnonzero(np.bincount(group, minlength=len(out) + 1)[group] > 1)
        tied = tied[key[out[tied]] & ((1 << index.bits) - 1) > 0] if h == index.per else tied
        if not len(tied):
            break
        at = out[tied]
        then = rank[np.minimum(at + h, len(rank) - 1)]
        by = np.lexsort((then, rank[at]))
        at, then, group = at[by], then[by], rank[at][by]
        new = np.r_[True, (group[1:] != group[:-1]) | (then[1:] != then[:-1])]
        out[tied] = at  # groups stay where they are, as ranks are places
        rank[at] = np.maximum.accumulate(np.where(new, tied + 1, 0))
        h *= 2
    return out


def _segments(window: int):
    def run(batches):
        for batch in batches:
            data, at = text_parts(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for i, j in whole_texts(at):
                t = terms(data, at[i : j + 1])
                for k in range(j - i):
                    a, b = int(t.first[k]), int(t.first[k + 1])
                    for s in range(a, max(a + 1, b - window + 1) if b > a else a, SEGMENT):
                        e = min(b, s + SEGMENT + window - 1)
                        whole = s == a and e == b
                        for column, value in zip(rows, (ids[i + k], s - a, whole, e - s, b" ".join(t.term(x) for x in range(s, e)).decode("utf-8", "replace")), strict=True):
                            column.append(value)
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["item", "at", "whole", "n", "words"])

    return run


def segments(items: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """The items' words in segments that share window - 1 words: (item, at, whole, n, words)."""
    rows = items.select(F.col(quoted(item)).cast("string").alias("item"), F.col(quoted(text)).alias("text"))
    return rows.mapInArrow(_segments(window), "item string, at bigint, whole boolean, n bigint, words string")


def _blocks(items: DataFrame, window: int, item: str, text: str, block: int):
    """Indexes of blocks of the items, one at a time."""
    parts = written(segments(items, window, item, text), "items", release=False)
    total = parts.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // block))
    for b in range(n):
        rows = parts.where(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == b).collect()
        yield Index([(r["item"], r["at"], r["whole"], r["words"]) for r in rows], window), b == n - 1


def _marked(index: Index, texts: bool):
    """texts: whether they go on."""

    def run(batches):
        for batch in batches:
            data, at = text_parts(batch.column(1))
            old = batch.column(3).to_pylist()
            before = batch.column(4).to_pylist()
            n_words, spans, names = [], [], []
            for i, j in whole_texts(at):
                t = terms(data, at[i : j + 1])
                n_words.append(np.diff(t.first))
                shard = Shard.of(t, index)
                window, size, where = shard.occurrences()
                hit = np.zeros(len(shard.words) + 1, np.int64)
                np.add.at(hit, where, 1)
                np.subtract.at(hit, where + size, 1)
                hit = np.cumsum(hit) > 0
                begin = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
                end = np.flatnonzero(hit[:-1] & ~hit[1:]) + 1
                in_text: dict[int, list] = {}
                for k, a, b in zip(shard.text[begin].tolist(), shard.place[begin].tolist(), (end - begin).tolist(), strict=True):
                    in_text.setdefault(k, []).append((a, a + b))
                met: dict[int, set] = {}
                for k, w in np.unique(np.stack([shard.text[where], window], axis=1), axis=0).tolist():
                    met.setdefault(k, set()).update(index.having[index.of_window[w] : index.of_window[w + 1]].tolist())
                for k in range(j - i):
                    spans.append(union((old[i + k] or []), in_text.get(k, [])))
                    names.append(sorted({*(before[i + k] or []), *(index.items[s] for s in met.get(k, ()) if index.items[s] is not None)}))
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            counts = pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64())
            text = batch.column(1) if texts else pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, counts, pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))], ["row", "text", "n_words", "spans", "items"])

    return run


def union(old: list, new: list) -> list[dict]:
    """Stretches of two lists, joined where they overlap or touch."""
    out: list[list[int]] = []
    for lo, hi in sorted([*((s["lo"], s["hi"]) for s in old), *new]):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [{"lo": lo, "hi": hi} for lo, hi in out]


def marks(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK, texts: bool = False) -> DataFrame:
    """docs as the struct `row` of all columns but the text, with n_words, the stretches of words (`spans`: lo, hi) that lie in an occurrence
    of a window, and the sorted ids, as strings, of the items that the windows are of. texts: `text` goes along."""
    ddl = "text string, n_words bigint, spans array<struct<lo:bigint,hi:bigint>>, items array<string>"
    rows = docs.select(
        whole_row(docs, text).alias("row"), F.col(quoted(text)).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for passes, (index, last) in enumerate(_blocks(items, window, item, item_text, block)):
        rows = written(rows, "marked") if passes else rows
        rows = rows.mapInArrow(_marked(index, texts or not last), with_row(rows, ddl))
    return rows if texts else rows.drop("text")


def report(marked: DataFrame) -> DataFrame:
    """n_hit, n_items, the digest of the items' ids and the verdict, beside the documents' own columns (but the text) and n_words; columns of
    these names that the documents came with give way."""
    n_hit: Column = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["hi"] - x["lo"])
    own = [F.col(f"row.{quoted(c)}") for c in marked.schema["row"].dataType.fieldNames() if c not in MADE]
    return marked.select(*own, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no window of any item, with the columns they came with."""
    kept = marks(docs, items, text=text, texts=True, **options).where(F.size("spans") == 0)
    return kept.select(*[F.col("text" if c == text else f"row.{quoted(c)}").alias(c) for c in docs.columns])


def _longest(index: Index):
    def run(batches):
        for batch in batches:
            data, at = text_parts(batch.column(1))
            for i, j in whole_texts(at):
                shard = Shard.of(terms(data, at[i : j + 1]), index)
                size, where = shard.longest()
                met = np.flatnonzero(size >= index.length)
                start = index.starts[met]
                segment = index.segment[start]
                ids = batch.column(0).take(pa.array(shard.text[where[met]] + i))
                names = pa.array([index.items[s] for s in segment.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(index.offset[segment] + index.place[start]), pa.array(size[met]), ids, pa.array(shard.place[where[met]])], ["item", "at", "words", "doc_id", "doc_at"])

    return run


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """For each item and each of its words at which a match of at least a window begins, the longest verbatim match in all documents and
    one place of it: (item, at, words, doc_id, doc_at), places counted in words from 0. Of equally long ones the smallest document's."""
    rows = docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    found_ = [rows.mapInArrow(_longest(index), f"item string, at bigint, words bigint, doc_id {kind}, doc_at bigint") for index, _ in _blocks(items, window, item, item_text, block)]
    every = found_[0]
    for more in found_[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("words")).alias("words"), F.col("doc_id").isNull().alias("none"), "doc_id", "doc_at")).alias("best")
    return every.groupBy("item", "at").agg(best).select("item", "at", (-F.col("best.words")).alias("words"), "best.doc_id", "best.doc_at")
