"""Near-duplicate classes by weighted MinHash signatures made of darts.

A text is a weighted set of word shingles. Darts fall on the plane of element x weight at ranks (times) that are a Poisson process,
the same one for every text because hashes of the element throw them; a dart hits a text if it lies below the element's weight. Each
of K coordinates keeps the earliest dart that hits, so two texts agree on a coordinate with the probability of their weighted Jaccard
similarity. A text needs about K ln K darts whatever its size: only ranks up to a bound divided by its total weight are thrown, and
for the few texts with a coordinate left empty the bound is doubled. Weights are cut into the bands 0-1, 1-2, 2-4, ...; elements throw
in the bands below their weight alone.

Coordinates are joined in bands of ROWS. Texts with an equal band meet in a bucket; a bucket never becomes all of its pairs. Its
smallest member is held against each other one, which makes most buckets of copies one component. Where members still fall into several
components, so is the member with the most common shingles, the likeliest original. What is left is joined exactly by its rarest shingles: a
pair at the threshold has its first common shingle, in the order of frequency, within a prefix of each text, at places that leave room for
the overlap it needs, which also bounds the sizes that can meet. Under a shingle that one component fills, only the others look for
partners, and its rows are dealt over several tasks. So no link among texts that share a band is lost, and a large group of copies costs no
pairs within itself.

The coordinates, a byte each, tell most pairs that are far apart: a pair at the threshold has fewer in common than is asked for with odds of
ODDS at most, whatever the threshold is; exact=True looks at every pair instead. Each pair is checked on the whole texts: shingles in common
over shingles in either, at least `similarity`. Classes are the connected components of the pairs that pass. The rows of a band are as many
as let a pair at the threshold share no band with odds of MISSED at most: five of 150 coordinates, and 7 in a million, at 0.8.

Cases: a null text counts as empty; texts without a word are one class; a text of fewer words than a shingle has is one shingle; equal
shingle sets are one node of the graph from the start, so exact copies cost one signature row each and no pair. A class is named by its
smallest key; keys that are null name none, and a class without any other is named by the smallest hash of its rows. Repeated rows (equal in
key and text) are one row to keep: `keep` is true for all of them, one_of_each() returns one. Ties: of equal keys the row with the smallest
hash stands for the class. Other columns take no part and may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, whole_row, written
from .fingerprints64 import M1, M2, M3, mix, text_parts, whole_texts
from .graph import components
from .shingles import distinct, shingles, words

WORDS = 5
SIMILARITY = 0.8
#: Coordinates of a signature, and the odds, for a pair at the threshold, to share no band and to differ in too many of them.
COORDINATES = 150
MISSED, ODDS = 1e-5, 1e-9
#: Rows of one shingle that a task joins.
KEY_ROWS = 256
#: Bytes of text whose darts are thrown together.
STRETCH = 1 << 18


def rows_of_a_band(similarity: float, k: int = COORDINATES, missed: float = MISSED) -> int:
    """As many as the odds allow; more rows mean fewer chance meetings."""
    fine = [r for r in range(1, k + 1) if (1.0 - similarity**r) ** (k // r) <= missed]
    return max(fine, default=1)


def least_agreeing(similarity: float, k: int, odds: float = ODDS) -> float:
    """The share of equal bytes that a pair of this similarity falls short of with `odds` at most: the binomial distribution's tail."""
    p = min(1.0 - 1e-12, similarity + (1.0 - similarity) / 256)
    total, i = 0.0, 0
    while i <= k:
        total += math.exp(math.lgamma(k + 1) - math.lgamma(i + 1) - math.lgamma(k - i + 1) + i * math.log(p) + (k - i) * math.log1p(-p))
        if total > odds:
            return i / k
        i += 1
    return 1.0


def throw(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sizes: np.ndarray, bound: np.ndarray, k: int):
    """Darts (owner, coordinate, rank, dart) that hit, up to the rank bound of each owner. sizes: total weights, for reference."""
    found, low, width = [], 0.0, 1.0
    band = np.uint64(1)
    live = np.arange(len(owner))
    while len(live):
        with np.errstate(over="ignore"):
            seed = mix(element[live] ^ (band * M3))
        at, rank, step, block = live, np.zeros(len(live)), 0, 4
        while len(at):
            with np.errstate(over="ignore"):
                dart = mix(seed[:, None] + np.arange(step + 1, step + block + 1, dtype=np.uint64) * M1)
            gap = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
            ranks = rank[:, None] + np.cumsum(gap, axis=1)
            limit = bound[owner[at]]
            hit = ranks <= limit[:, None]
            with np.errstate(over="ignore"):
                mark = mix(dart ^ M2)
                height = low + width * ((mix(mark + M3) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            hit_in = hit & (height < weight[at][:, None])
            i, j = np.nonzero(hit_in)
            found.append((owner[at][i], (mark[i, j] % np.uint64(k)).astype(np.int64), ranks[i, j], mark[i, j]))
            more = hit[:, -1]
            at, seed, rank = at[more], seed[more], ranks[more, -1]
            step, block = step + block, min(64, block * 2)
        low, width = low + width, max(1.0, low + width)
        band += np.uint64(1)
        live = live[weight[live] > low]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)]


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, owners: int, k: int) -> np.ndarray:
    """owners x k: the mark of the earliest dart of each coordinate. Owners without elements keep zeros."""
    out = np.zeros((owners, k), np.uint64)
    total = np.bincount(owner, weight, owners)
    left = total > 0
    bound = np.where(left, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9), 0.0)
    while left.any():
        use = left[owner]
        o, c, r, d = throw(owner[use], element[use], weight[use].astype(np.float64), total, bound, k)
        cell = o * k + c
        order = np.lexsort((r, cell))
        cell, d = cell[order], d[order]
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        out.reshape(-1)[cell[new]] = d[new]
        full = np.bincount(cell[new] // k, minlength=owners) == k
        left &= ~full
        bound[left] *= 2
    return out


def _sign(n: int, rows: int, bands: int, weighted: bool):
    k = rows * bands

    def run(batches):
        for batch in batches:
            data, at = text_parts(batch.column(1))
            texts = len(at) - 1
            node, size, marks = np.zeros(texts, np.int64), np.zeros(texts, np.int64), np.zeros((texts, bands), np.int64)
            sketch = np.zeros((texts, k), np.uint8)
            for i, count, starts, ends in whole_texts(at, STRETCH):
                owner, h, weight = elements(data, starts, ends, n)
                if not weighted:
                    weight = np.ones(len(h), np.int64)
                with np.errstate(over="ignore"):
                    one = mix(h * M3 + weight.astype(np.uint64))
                    sums = np.zeros(count, np.uint64)
                    np.add.at(sums, owner, one)
                    sizes = np.bincount(owner, minlength=count)
                    node[i : i + count] = mix(sums + sizes.astype(np.uint64) * M1).view(np.int64)
                    size[i : i + count] = sizes
                    sig = signatures(owner, h, weight, count, k)
                    sketch[i : i + count] = (sig >> np.uint64(56)).astype(np.uint8)
                    band = np.full((count, bands), M1) + np.arange(bands, dtype=np.uint64) * M3
                    for j in range(rows):
                        band = mix(band + sig[:, j::rows][:, :bands])
                    marks[i : i + count] = band.view(np.int64)
            filled = size > 0
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(filled * bands)].astype(np.int32)), pa.array(marks[filled].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node), pa.array(size), lists, _bytes(sketch)], ["id", "key", "node", "size", "bands", "sketch"])

    return run


def _bytes(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    at = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(rows.tobytes())])


def _agreeing(share: float):
    """Keeps the pairs (a, b) whose sketches have that share of bytes in common."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (text_parts(batch.column(c))[0] for c in (2, 3))
            (xs, ys) = (text_parts(batch.column(c))[1] for c in (2, 3))
            x, y = x[xs[0] : xs[-1]].reshape(batch.num_rows, -1), y[ys[0] : ys[-1]].reshape(batch.num_rows, -1)
            keep = pa.array((x == y).mean(1) >= share)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def elements(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int):
    """text, hash and count of the distinct shingles of texts that lie one after the other."""
    if ends[-1] == starts[0]:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    _, _, text, h = words(data, starts, ends)
    return distinct(*shingles(text, h, len(starts), n))


def _checked(n: int, similarity: float, weighted: bool):
    """Keeps the pairs (a, b) whose texts are similar."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = []
            for c in (2, 3):
                data, at = text_parts(batch.column(c))
                per = []
                for _, count, starts, ends in whole_texts(at):
                    owner, h, w = elements(data, starts, ends, n)
                    cut = np.searchsorted(owner, np.arange(count + 1))
                    per += [(h[cut[j] : cut[j + 1]], w[cut[j] : cut[j + 1]]) for j in range(count)]
                sides.append(per)
            for r, ((ha, wa), (hb, wb)) in enumerate(zip(*sides, strict=True)):
                if not weighted:
                    both = len(np.intersect1d(ha, hb, assume_unique=True))
                    either = len(ha) + len(hb) - both
                else:
                    _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                    both = int(np.minimum(wa[x], wb[y]).sum())
                    either = int(wa.sum() + wb.sum()) - both
                keep[r] = both >= similarity * either - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def classes(docs: DataFrame, key: str = "doc_id", n: int = WORDS, similarity: float = SIMILARITY, coordinates: int = COORDINATES, weighted: bool = False, exact: bool = False) -> DataFrame:
    """(id, key, class_id, keep): a row for each row of docs. id is row_id()'s, class_id the smallest key of the class; keep is true for
    rows equal to the one that stands for it. weighted: shingle counts are weights; else each distinct shingle weighs one. exact: no pair is
    told by its coordinates."""
    rows = rows_of_a_band(similarity, coordinates)
    bands = coordinates // rows
    base = docs.select(row_id(key).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col(key).alias("key"))
    kind = base.schema["key"].dataType.simpleString()
    made: list[DataFrame] = []

    def kept(df: DataFrame, label: str, release: bool = False) -> DataFrame:
        made.append(written(df, label, release))
        return made[-1]

    signed = kept(base.mapInArrow(_sign(n, rows, bands, weighted), f"id bigint, key {kind}, node bigint, size bigint, bands array<bigint>, sketch binary"), "signatures", True)
    band = signed.select("node", F.explode("bands").alias("band"))
    buckets = band.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("other")).where("center < other").select("band", "center")
    members = kept(band.join(buckets, "band").groupBy("band", "node").agg(F.first("center").alias("center")), "members", True)
    # one text for each node that meets another, in the order of a hash, not of the input
    nodes = signed.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"))
    texts = kept(nodes.join(base.select("id", "text"), "id").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text")), "texts", True)
    check, agree = _checked(n, similarity, weighted), least_agreeing(similarity, rows * bands)

    def sides(pairs: DataFrame, column: str) -> DataFrame:
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
        return left.join(texts.select(F.col("node").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")

    def passed(pairs: DataFrame) -> DataFrame:
        near = pairs if exact else sides(pairs, "sketch").mapInArrow(_agreeing(agree), "a bigint, b bigint")
        return kept(sides(near, "text").mapInArrow(check, "a bigint, b bigint"), "links")

    links = passed(members.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())
    component = components(links)

    def undecided() -> DataFrame:
        known = members.join(component, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        several = known.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("band")
        return kept(known.join(several, "band", "left_semi"), "open")

    rest = undecided()
    tokens = texts.join(rest.select("node").distinct(), "node").select("node", "text").mapInArrow(_tokens(n, weighted), "node bigint, tokens array<bigint>")
    ranked = kept(by_frequency(tokens), "tokens")
    original = rest.join(ranked.select("node", "common"), "node").groupBy("band").agg(F.max(F.struct("common", "node", "component")).alias("top"))
    pairs = rest.join(original, "band").where("component != top.component").select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()
    links = links.unionByName(passed(pairs))
    component = components(links)
    rest = undecided().groupBy("node").agg(F.first("component").alias("component"))
    links = links.unionByName(passed(prefix_pairs(ranked.join(rest, "node"), similarity, kept)))
    component = components(links)
    named = signed.select("id", "key", "node").join(component, "node", "left").select("id", "key", F.coalesce("component", "node").alias("component"))
    lead = named.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "id")).alias("lead"))
    name = F.coalesce("lead.key", F.col("lead.id").try_cast(kind))
    out = named.join(lead, "component").select("id", "key", name.alias("class_id"), (F.col("id") == F.col("lead.id")).alias("keep"))
    out = written(out, "classes")
    for table in made:  # nothing reads them any more
        dropped(table)
    return out


def by_frequency(sets: DataFrame) -> DataFrame:
    """(node, size, common, order) of sets (node, tokens): the tokens from rare to frequent, and how frequent they are on average."""
    frequency = sets.select(F.explode("tokens").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    each = sets.select("node", F.explode("tokens").alias("h")).join(frequency, "h")
    return each.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("size"), F.avg(F.log("df")).alias("common"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))


def prefix_pairs(ordered: DataFrame, t: float, write=written) -> DataFrame:
    """(a, b): pairs of sets (node, component, size, order) of different components; all that have a Jaccard similarity of t or more are
    among them."""
    prefix = F.slice("order", F.lit(1), (F.col("size") * (1 - t) + 1 + 1e-9).cast("int"))
    rows = ordered.select("node", "component", "size", F.posexplode(prefix).alias("pos", "o")).where("o.df > 1").select("node", "component", "size", "pos", F.col("o.h").alias("h"))
    rows = write(rows, "prefixes", release=False)
    eps, level = F.lit(1e-6), lambda s: F.floor(F.log(s) / F.lit(0.2)).cast("int")
    small = rows.where(F.col("pos") <= F.col("size") * ((1 - t) / (1 + t)) + eps).withColumn("level", level(F.col("size").cast("double")))
    most = F.least(F.col("size").cast("double"), (F.col("size") - F.col("pos")) * ((1 + t) / t) - F.col("size") + eps)
    least = F.col("size") * t - eps
    large = rows.where(most >= least).withColumn("level", F.explode(F.sequence(level(F.greatest(least, F.lit(1.0))), level(F.greatest(most, F.lit(1.0))))))
    by = ["h", "level"]
    counts = small.select(*by, "component").unionByName(large.select(*by, "component")).groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy(*by).agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).where("k > 1")
    # a shingle with many rows is dealt over several tasks: the side that one component fills by a hash, the others' rows to each of them
    main = write(main.select(*by, F.col("top.component").alias("main"), F.ceil(F.col("all") / KEY_ROWS).cast("int").alias("deals")), "mains", release=False)

    def name(df: DataFrame, x: str, dealt: bool) -> DataFrame:
        deal = F.pmod(F.xxhash64("node"), F.col("deals")).cast("int") if dealt else F.explode(F.sequence(F.lit(0), F.col("deals") - 1))
        return df.join(main, by).select(*by, "main", deal.alias("deal"), *[F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "size", "pos")])

    need = (F.col("s_size") + F.col("g_size")) * (t / (1 + t)) - eps
    fits = (F.col("s_component") != F.col("g_component")) & (F.col("s_size") <= F.col("g_size")) & (F.col("s_size") - F.col("s_pos") >= need) & (F.col("g_size") - F.col("g_pos") >= need)
    on = [*by, "deal"]
    minor = name(small, "s", False).where("s_component != main").drop("main").join(name(large, "g", True).drop("main"), on).where(fits)
    major = name(small, "s", True).where("s_component = main").drop("main").join(name(large, "g", False).where("g_component != main").drop("main"), on).where(fits)
    both = minor.unionByName(major)
    return both.select(F.least("s_node", "g_node").alias("a"), F.greatest("s_node", "g_node").alias("b")).distinct()


def _tokens(n: int, weighted: bool):
    """The distinct shingles of texts; where they are weighted, each as often as it weighs, under numbers of its own."""

    def run(batches):
        for batch in batches:
            data, at = text_parts(batch.column(1))
            flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, count, starts, ends in whole_texts(at):
                owner, h, weight = elements(data, starts, ends, n)
                if weighted:
                    turn = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                    with np.errstate(over="ignore"):
                        owner, h = np.repeat(owner, weight), mix(np.repeat(h, weight) + turn.astype(np.uint64) * M1)
                flat.append(h.view(np.int64))
                sizes.append(np.bincount(owner, minlength=count))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32)), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "tokens"])

    return run


def row_id(key: str = "doc_id"):
    """Equal for rows that are equal in key and text."""
    return F.xxhash64(key, F.coalesce("text", F.lit("")))


def one_of_each(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without all but one row of each class."""
    kept = classes(docs, key, **how).where("keep").select(F.col("id").alias("_row")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), row_id(key).alias("_row"))
    return rows.join(kept, "_row", "left_semi").groupBy("_row").agg(F.first("row").alias("row")).select("row.*")
