"""Removal of byte strings of a given length that start more than once in a corpus, by prefix-free parsing.

Parsing. Triggers, places whose rolling hash is divisible by prefix_free.DIVISOR, cut a text into phrases. The trigger of a window (a string
of WIDTH bytes) is the first one among its first GAP places, or the place of the smallest hash where it has none there (runs of one
character, say). It depends on the window's own bytes alone: equal windows are cut at equal places whatever stands around them, the
prefix-free property, and no stretch is without a trigger. The windows of one trigger form a phrase here, with its context, all the bytes
that they cover, and its core, the bytes after the trigger that each of them holds.

Dictionary. Distinct contexts are counted by core, in parts dealt by hash:
  * A context that occurs twice: all windows of the phrase are repeats.
  * A core that occurs once: none is, whatever surrounds it.
  * Otherwise the phrase is at the edge of a repeat, and its windows are put in order together with those of one phrase (the witness) for
    each repeated context with the same core.

Order. Edges and witnesses of a core meet with their bytes in one part. There their texts are parsed again, the suffix arrays of the
dictionary of phrases and of the parse are made, and both are merged into the order of all windows (prefix_free.corpus_order): repeats are
neighbours that agree in WIDTH bytes. Only edges are looked at by position, so a fraction of a corpus's suffixes is moved or sorted.

Spread. Records are packed by part and dealt over tasks as blobs. What a task already knows to be repeated is answered there and sent on
once, so a context reaches a part once a task at most, however many copies the corpus holds. A core with many contexts within a task (a line
that every text has, between texts of all kinds) would be one hot group: its contexts are dealt by themselves, and the windows of its edges
by their own 128-bit hashes, each once a task.

Cases: a null text counts as empty; texts shorter than WIDTH lose nothing; repeated rows are occurrences like any other, so
equal texts of WIDTH bytes or more lose all bytes; matches never cross documents; texts of any length are read in tiles; an input's own
columns of any name are kept, but for those made here. Contexts count as equal if 64 bits of their core's hash and 64 of their own agree:
contexts of different cores differ in both with odds of about n*n/2**129 among n phrases, k contexts of one core in k*k/2**65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row, with_row, written
from .fingerprints64 import Rolling, packed, received, sent, sent_texts, slices, text_parts
from .pieces import ragged
from .prefix_free import DIVISOR, corpus_order, is_trigger

WIDTH = 200
GAP = 112
#: Bytes of input for one part of the dictionary, records that a task gathers before it sends them, and bytes that are put in order at once.
PART_BYTES = 32 << 20
FLUSH = 1 << 21
AT_ONCE = 1 << 20
#: A core with more contexts than this within a task is dealt by context instead.
HOT_CORE = 4

IN, EDGE, WITNESS, HOT = 1, 2, 4, 8
REP, BY_CONTEXT, CORE_REP, ANSWER = 1, 2, 4, 8
PHRASE = np.dtype([("core", "<u8"), ("full", "<u8"), ("key", "<i8"), ("lo", "<u4"), ("span", "u1"), ("flag", "u1")])
REPLY = np.dtype([("lo", "<u4"), ("span", "u1"), ("state", "u1")])
CONTEXT = np.dtype([("core", "<u8"), ("key", "<i8"), ("lo", "<u4"), ("span", "u1"), ("flag", "u1")])
WINDOW = np.dtype([("hash", "<u8"), ("other", "<u8"), ("key", "<i8"), ("lo", "<u4"), ("flag", "u1")])
PLACE = np.dtype([("lo", "<u4")])
#: Of the second, independent hash of a window.
SEED = 0x5BF0363501F3A1D7
TO_KEY = [("key", "<i8")]


def triggers(roll: Rolling, windows: int, gap: int, divisor: int = DIVISOR) -> np.ndarray:
    """The trigger of the windows that start at 0, 1, ... of a buffer of less than 2**20 + 1 bytes."""
    n = len(roll.at)
    marked = np.where(is_trigger(roll, divisor), np.arange(n), n + gap)
    marked = np.minimum.accumulate(marked[::-1])[::-1][:windows]
    without = marked - np.arange(windows) >= gap
    if not without.any():
        return marked
    low = np.uint64((1 << 20) - 1)
    key = (roll.at & ~low) | np.arange(len(roll.at), dtype=np.uint64)
    size = 1
    while size * 2 <= gap:  # smallest of 2, 4, 8, ... positions
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if gap > size:
        key = np.minimum(key[: len(key) - (gap - size)], key[gap - size :])
    return np.where(without, (key[:windows] & low).astype(np.int64), marked)


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gap: int):
    """Of texts that lie one after the other: row, first and last window start, core and context fingerprints, and the buffer's start."""
    base = int(starts[0])
    buf = data[base : int(ends[-1])]
    windows = len(buf) - width + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), None
    roll = Rolling(buf)
    at = triggers(roll, windows, gap)
    valid = np.ones(windows, bool)
    for e in ends[:-1] - base:  # windows that would leave their text
        valid[max(0, e - width + 1) : e] = False
    lengths = ends - starts
    if (lengths < width).any():
        valid &= np.repeat(lengths >= width, lengths)[:windows]
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    t = at[lo]
    core = roll.of(t, t + (width - gap + 1))
    full = roll.of(lo, hi + width)
    row = np.searchsorted(ends - base, lo, side="right")
    return row, lo - (starts[row] - base), hi - lo, core, full, roll


def _runs(*columns: np.ndarray):
    """The order that sorts by columns (the first counts most), and where each run of equal values starts in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _counts(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each element, in its own place, the size of its run."""
    sizes = np.diff(np.r_[first, len(order)])
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def _sent(rec: np.ndarray, parts: int):
    """Batches (part, blob) of phrases: one a context, and answers for those that are repeated right here."""
    core, full = rec["core"], rec["full"]
    order, first = _runs(core, full)
    twice = _counts(order, first) > 1
    keep = np.zeros(len(rec), bool)
    keep[order[first]] = True
    answers = rec[twice].copy()
    answers["flag"] = ANSWER
    rec, twice = rec[keep].copy(), twice[keep]
    rec["flag"][twice] = REP
    order, first = _runs(rec["core"])
    hot = _counts(order, first) > HOT_CORE
    reps = rec[order[first]]
    reps = reps[hot[order[first]]].copy()
    reps["flag"] = CORE_REP
    rec["flag"][hot] |= BY_CONTEXT
    part = np.where(hot, rec["full"], rec["core"]) % np.uint64(parts)
    to = np.r_[part, reps["core"] % np.uint64(parts), (np.arange(len(answers)) * parts // max(1, len(answers))).astype(np.uint64)]
    return sent(to.astype(np.int64), np.concatenate([rec, reps, answers]))


def _parse(width: int, gap: int, parts: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, at = text_parts(batch.column(1))
            for i, _, starts, ends, offset in slices(at, width - 1):
                row, lo, span, core, full, _ = phrases(data, starts, ends, width, gap)
                rec = np.zeros(len(row), PHRASE)
                rec["core"], rec["full"], rec["key"], rec["lo"], rec["span"] = core, full, keys[i + row], lo + offset, span
                held.append(rec)
                n += len(rec)
                if n >= FLUSH:
                    yield _sent(np.concatenate(held), parts)
                    held, n = [], 0
        if n:
            yield _sent(np.concatenate(held), parts)

    return run


def _dictionary(table: pa.Table) -> np.ndarray:
    """Answers of one part: which phrases are repeats, which are edges of one, and which stand for a context that edges are held against."""
    rec = received(table.column("blob"), PHRASE)
    answer = (rec["flag"] & ANSWER) > 0
    known, rec = rec[answer], rec[~answer]
    by_context, core_rep, rep = ((rec["flag"] & x) > 0 for x in (BY_CONTEXT, CORE_REP, REP))
    order, first = _runs(by_context, rec["core"], core_rep, rec["full"])
    repeated = ((_counts(order, first) > 1) | rep) & ~core_rep
    leads = np.zeros(len(rec), bool)
    leads[order[first]] = True
    order, first = _runs(by_context, rec["core"])
    # whether the core is hot in any task: then all its edges go the way by windows
    warm = np.zeros(len(first), bool)
    group = np.empty(len(rec), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    edge = ~repeated & ~core_rep & ((_counts(order, first) > 1) | by_context)
    asked = np.zeros(len(first), bool)
    asked[group[edge | core_rep | by_context]] = True
    warm[group[core_rep | by_context]] = True
    heat = np.where(warm[group], HOT, 0)
    told = (repeated | edge) & ~rep
    witness = repeated & leads & asked[group]
    state = np.r_[np.full(len(known), IN), np.where(repeated, IN, EDGE + heat)[told], (WITNESS + heat)[witness]]
    rec = np.concatenate([known, rec[told], rec[witness]])
    out = np.zeros(len(rec), TO_KEY + REPLY.descr)
    out["key"], out["lo"], out["span"], out["state"] = rec["key"], rec["lo"], rec["span"], state
    return out


def _answering(order_part, parts: int):
    """A part's answers, dealt by the key of their text."""

    def run(table: pa.Table) -> pa.Table:
        out = order_part(table)
        return pa.Table.from_batches([sent((out["key"].view(np.uint64) % np.uint64(parts)).astype(np.int64), out)])

    return run


def _by_key(reply: np.dtype):
    """The answers of each text: (key, blob, looks); looks: not all of them are repeats."""
    dtype = np.dtype(TO_KEY + reply.descr)

    def run(table: pa.Table) -> pa.Table:
        rec = received(table.column("blob"), dtype)
        out = np.zeros(len(rec), reply)
        for f in reply.names:
            out[f] = rec[f]
        keys, blobs = packed(rec["key"], out)
        looks = np.zeros(len(keys), bool)
        if "state" in reply.names:
            looks[np.searchsorted(keys, rec["key"][rec["state"] != IN])] = True
        return pa.table({"key": pa.array(keys), "blob": blobs, "looks": pa.array(looks)})

    return run


def _edges(width: int, gap: int, parts: int):
    """Edges and witnesses: contexts with their bytes, by core; of hot cores the hashes of windows, by hash."""

    def of_windows(rec: np.ndarray) -> pa.RecordBatch:
        order, first = _runs(rec["hash"], rec["other"])
        twice = _counts(order, first) > 1
        keep = np.zeros(len(rec), bool)
        keep[order[first]] = True
        answers = rec[twice & (rec["flag"] == 0)].copy()
        answers["flag"] = ANSWER
        kept = rec[keep].copy()
        kept["flag"][twice[keep]] = REP
        to = np.r_[(kept["hash"] % np.uint64(parts)).astype(np.int64), np.arange(len(answers)) * parts // max(1, len(answers))]
        batch = sent(to, np.concatenate([kept, answers]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(batch.num_rows, pa.binary())], ["part", "blob", "texts"])

    def of_contexts(rec: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        return sent_texts((rec["core"] % np.uint64(parts)).astype(np.int64), rec, data, rec["span"].astype(np.int64) + width)

    def run(batches):
        cold, data, hot, n = [], [], [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            raw, at = text_parts(batch.column(1))
            replies = batch.column(2)
            for i, rows, starts, ends, offset in slices(at, width - 1):
                base, found = int(starts[0]), []
                for r in range(rows):
                    told = _records(replies[i + r])
                    lo = told["lo"].astype(np.int64) - offset
                    told = told[(told["state"] != IN) & (lo >= 0) & (lo <= ends[r] - starts[r] - width)]
                    found.append((told["lo"] - offset + (starts[r] - base), np.full(len(told), r), told["span"].astype(np.int64), told["state"]))
                lo, owner, span, state = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(lo):
                    continue
                buf = raw[base : int(ends[-1])]
                roll = Rolling(buf)
                flag = np.where((state & WITNESS) > 0, REP, 0)
                text_lo = lo - (starts[owner] - base) + offset
                m = (state & HOT) == 0
                if m.any():
                    t = triggers(roll, len(buf) - width + 1, gap)[lo[m]]
                    rec = np.zeros(int(m.sum()), CONTEXT)
                    rec["core"], rec["key"], rec["lo"], rec["span"], rec["flag"] = roll.of(t, t + (width - gap + 1)), keys[i + owner[m]], text_lo[m], span[m], flag[m]
                    cold.append(rec)
                    data.append(buf[ragged(lo[m], span[m] + width)])
                    n += 16 * len(rec)
                m = ~m
                if m.any():
                    size = span[m] + 1
                    p = ragged(lo[m], size)
                    rec = np.zeros(len(p), WINDOW)
                    rec["hash"], rec["other"] = roll.of(p, p + width), Rolling(buf, SEED).of(p, p + width)
                    rec["key"], rec["lo"], rec["flag"] = np.repeat(keys[i + owner[m]], size), p - np.repeat(lo[m] - text_lo[m], size), np.repeat(flag[m], size)
                    hot.append(rec)
                    n += len(rec)
                if n >= FLUSH:
                    if cold:
                        yield of_contexts(np.concatenate(cold), np.concatenate(data))
                    if hot:
                        yield of_windows(np.concatenate(hot))
                    cold, data, hot, n = [], [], [], 0
        if cold:
            yield of_contexts(np.concatenate(cold), np.concatenate(data))
        if hot:
            yield of_windows(np.concatenate(hot))

    return run


def _records(blobs, dtype=REPLY) -> np.ndarray:
    return np.frombuffer(blobs.as_py() or b"", dtype)


def repeated_windows(rec: np.ndarray, data: np.ndarray, width: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts (their bytes one after the other): context and start of each window, not a witness's, that occurs twice among those of the
    same core. Cores are put in order together, as many as fit `at_once` bytes."""
    size = rec["span"].astype(np.int64) + width
    begin = np.cumsum(size) - size
    by_core = np.argsort(rec["core"], kind="stable")
    core, filled = rec["core"][by_core], np.cumsum(size[by_core])
    ends = np.flatnonzero(np.r_[core[1:] != core[:-1], True]) + 1 if len(core) else np.zeros(0, np.int64)
    out, lo = [], 0
    while lo < len(by_core):
        full = (filled[lo - 1] if lo else 0) + at_once
        hi = int(ends[max(np.searchsorted(ends, lo, side="right"), min(np.searchsorted(filled[ends - 1], full, side="right") - 1, len(ends) - 1))])
        mine = by_core[lo:hi]
        n = size[mine]
        stop = np.cumsum(n)
        start = stop - n
        text = data[ragged(begin[mine], n)]
        many = rec["span"][mine].astype(np.int64) + 1
        places, owner = ragged(start, many), np.repeat(np.arange(len(mine)), many)
        order, same = corpus_order(text, start, stop, places, width)
        twice = same.copy()
        twice[:-1] |= same[1:]
        hit = order[twice]
        hit = hit[rec["flag"][mine[owner[hit]]] == 0]
        out.append((mine[owner[hit]], places[hit] - start[owner[hit]]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _places(width: int):
    """Answers of one part: the places of windows that are repeats."""

    def run(table: pa.Table) -> np.ndarray:
        cold = table.column("texts").is_valid()
        hot = table.filter(pc.invert(cold))
        rec = received(hot.column("blob"), WINDOW)
        answer = (rec["flag"] & ANSWER) > 0
        known, rec = rec[answer], rec[~answer]
        order, first = _runs(rec["hash"], rec["other"])
        told = (_counts(order, first) > 1) & (rec["flag"] == 0)
        cold = table.filter(cold)
        context = received(cold.column("blob"), CONTEXT)
        data = np.frombuffer(b"".join(x.as_py() for x in cold.column("texts")), np.uint8)
        which, start = repeated_windows(context, data, width)
        rec = np.concatenate([known, rec[told]])
        out = np.zeros(len(rec) + len(which), TO_KEY + PLACE.descr)
        out["key"], out["lo"] = np.r_[rec["key"], context["key"][which]], np.r_[rec["lo"], context["lo"][which] + start]
        return out

    return run


def spans(n: int, phrase_replies: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The stretches (start, end) that repeated windows cover, apart from each other and in order."""
    inside = phrase_replies[phrase_replies["state"] == IN]
    lo = np.r_[inside["lo"].astype(np.int64), places.astype(np.int64)]
    hi = np.r_[inside["lo"].astype(np.int64) + inside["span"], places.astype(np.int64)] + width
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.minimum(np.maximum.accumulate(hi[order]), n)
    new = np.r_[True, lo[1:] > hi[:-1]]
    first = np.flatnonzero(new)
    return np.stack([lo[first], hi[np.r_[first[1:] - 1, len(hi) - 1]]], 1)


def _cut(width: int):
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and the text that stays; bytes of characters cut through go from the text alone."""

    def run(batches):
        for batch in batches:
            raw = batch.column("raw")
            rows = []
            for b, phrase, place in zip(raw, batch.column("phrases"), batch.column("places"), strict=True):
                text = b.as_py()
                cut = spans(len(text), _records(phrase), _records(place, PLACE)["lo"], width)
                at, keep = 0, []
                for lo, hi in cut.tolist():
                    keep.append(text[at:lo])
                    at = hi
                keep.append(text[at:])
                left = b"".join(keep)
                rows.append((len(text), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts of the dictionary: by the optimiser's estimate of the input's size, at least one for each shuffle partition."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = 1 << 20
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, size // part_bytes))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gap: int = GAP, key: str = "doc_id", texts: bool = True) -> DataFrame:
    """docs without their text, with n_bytes, n_removed, n_spans, kept_sha256 and, if texts are asked for, kept_text; one row out for each
    row in."""
    if not 8 <= gap <= width - 8 or gap > 255:
        raise ValueError("gap must leave room for a core of eight bytes and fit a byte")
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * texts]
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    # the row travels as one struct, so that no column of the input meets a name used here; rows with the same key are equal in
    # id and text, and get equal answers
    rows = docs.select(whole_row(docs, *made, "text").alias("row"), text, F.xxhash64(F.col(key), text).alias("id"))
    parts = parts_for(docs.select("text"))
    parsed = rows.where(F.octet_length("text") >= width).select("id", "text").mapInArrow(_parse(width, gap, parts), "part int, blob binary")
    packs, answers = "part int, blob binary", "key bigint, blob binary, looks boolean"
    replies = parsed.groupBy("part").applyInArrow(_answering(_dictionary, parts), packs).groupBy("part").applyInArrow(_by_key(REPLY), answers)
    replies = replies.withColumnRenamed("blob", "phrases")
    joined = rows.join(replies, F.col("id") == F.col("key"), "left").drop("key").withColumn("found", F.col("phrases").isNotNull())
    if not texts:  # what is untouched needs no text from here on
        joined = joined.select("row", "id", F.when(F.col("found"), F.col("text")).alias("text"), "phrases", "looks", "found", F.octet_length("text").alias("size"), F.when(~F.col("found"), F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    else:
        joined = joined.withColumns({"size": F.octet_length("text"), "digest": F.when(~F.col("found"), F.sha2(F.col("text").cast("binary"), 256))})
    joined = written(joined, "repeats")
    at_edge = joined.where("looks")
    edges = at_edge.select("id", "text", "phrases").mapInArrow(_edges(width, gap, parts), "part int, blob binary, texts binary")
    places = edges.groupBy("part").applyInArrow(_answering(_places(width), parts), packs).groupBy("part").applyInArrow(_by_key(PLACE), answers)
    places = places.select("key", F.col("blob").alias("places"))
    with_edge = at_edge.join(places, F.col("id") == F.col("key"), "left").drop("key")
    inside = joined.where("found and not looks").withColumn("places", F.lit(None).cast("binary"))
    cut_in = with_edge.unionByName(inside).select("row", F.col("text").cast("binary").alias("raw"), "phrases", "places")
    cut = cut_in.mapInArrow(_cut(width), with_row(rows, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"))
    none = F.lit(0).cast("bigint")
    same = joined.where("not found").select(
        "row", F.col("size").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("digest").alias("kept_sha256"), F.col("text").alias("kept_text"),
    )
    return cut.unionByName(same).select("row.*", *made)
