"""Importance resampling to a target distribution: features are runs of 1 to n words, hashed to buckets; a document weighs what its features
weigh on average, and the highest weights under a fixed noise are drawn.

Each slice of a partition's texts is held as a trie of words: a node is a run of words, and holds how often the run comes and the CRC state of
its bytes, from which a child's state goes on with a space and one word more. So each distinct run is hashed once. A first pass adds the
nodes' counts up by bucket, a row a bucket and partition is merged; a second pass walks the trie paths of each document, with the buckets'
gains attached to the nodes. A trie lives for one slice of whole texts, so memory is bounded by the slice (or one longer text).

What is ranked over all documents is their score, an integer. Gains lie within 1000 * ln(2^63 * 2^63) on either side and the noise between
-3131 and 22182, so there are at most 200,000 distinct scores whatever the corpus: counts by score give where each score's ranks begin, and
only drawn documents are moved, by score. Ids are meant to be unique; rows of one id and score take consecutive ranks.

Null and empty texts have no features and weight 0. A null id draws the noise of an empty one and loses ties. With no documents to draw from
nothing is drawn. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, whole_row, with_row, written
from .fingerprints64 import text_parts
from .terms import Terms, same_bytes, terms, whole_texts

N = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024


def first_level(t: Terms) -> tuple[np.ndarray, list[bytes]]:
    """The node of each word of a slice, and the word of each node."""
    _, first, node = np.unique(t.hashes(), return_index=True, return_inverse=True)
    size = t.hi - t.lo
    if not (size == size[first][node]).all() or not same_bytes(t.buf, t.lo, t.buf, t.lo[first][node], size).all():
        numbers: dict[bytes, int] = {}  # two words under one hash: by their bytes
        node = np.array([numbers.setdefault(t.term(i), len(numbers)) for i in range(len(t.lo))], np.int64)
        return node, list(numbers)
    return node, [t.term(i) for i in first.tolist()]


def levels(t: Terms, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The trie of a slice, level by level: (CRC states, counts) of the nodes of runs of k words, and (places, their nodes) of the paths."""
    word, names = first_level(t)
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    place, node = np.arange(len(word)), word
    state = np.array([zlib.crc32(b) for b in names], np.int64)
    for k in range(1, n + 1):
        yield state, np.bincount(node, minlength=len(state)), place, node
        if k == n:
            return
        inside = place + k < len(word)
        place, node = place[inside], node[inside]
        inside = text[place] == text[place + k]
        place, node = place[inside], node[inside]
        path, node = np.unique(node * len(names) + word[place + k], return_inverse=True)
        state = np.array([zlib.crc32(b" " + names[c], s) for s, c in zip(state[path // max(1, len(names))].tolist(), (path % max(1, len(names))).tolist(), strict=True)], np.int64)


def _counted(n: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = text_parts(batch.column(0))
            for i, j in whole_texts(at):
                for state, count, _, _ in levels(terms(data, at[i : j + 1]), n):
                    np.add.at(total, state % buckets, count)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    return run


def bucket_totals(docs: DataFrame, n: int = N, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """How many features of all texts fall into each bucket that has any: (bucket, n)."""
    rows = docs.select(F.col(quoted(text)).alias("text"))
    return rows.mapInArrow(_counted(n, buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, text: str = "text", target_text: str = "text") -> np.ndarray:
    """The gain of each bucket, floor(1000 * ln of the ratio of its smoothed shares in target and docs); as many as there are buckets."""
    both = bucket_totals(docs, n, buckets, text).withColumn("t", F.lit(0).cast("bigint")).unionByName(bucket_totals(target, n, buckets, target_text).withColumnsRenamed({"n": "t"}).withColumn("n", F.lit(0).cast("bigint")))
    found = np.zeros((2, buckets), np.int64)
    for bucket, s, t in both.groupBy("bucket").agg(F.sum("n"), F.sum("t")).collect():
        found[:, bucket] = s, t
    (s, t), (all_s, all_t) = found.astype(np.float64), found.sum(axis=1).astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def _weighed(n: int, gain: np.ndarray):
    def run(batches):
        for batch in batches:
            data, at = text_parts(batch.column(1))
            words, features, weight = [], [], []
            for i, j in whole_texts(at):
                t = terms(data, at[i : j + 1])
                total, count = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for state, _, place, node in levels(t, n):
                    sums = np.r_[0, np.cumsum(gain[state % len(gain)][node])]
                    cut = np.searchsorted(place, t.first)
                    total += np.diff(sums[cut])
                    count += np.diff(cut)
                words.append(np.diff(t.first))
                features.append(count)
                weight.append(total // np.maximum(count, 1))
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (words, features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "n_words", "n_features", "weight"])

    return run


def weighed(docs: DataFrame, gain: np.ndarray, n: int = N, text: str = "text") -> DataFrame:
    """docs as the struct `row` of all columns but the text, with n_words, n_features and weight, the floored mean of the gains of a document's
    features."""
    rows = docs.select(whole_row(docs, text).alias("row"), F.col(quoted(text)).alias("text"))
    return rows.mapInArrow(_weighed(n, gain), with_row(rows, "n_words bigint, n_features bigint, weight bigint"))


def resampled(
    docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """docs as the struct `row` of all columns but the text, with n_words, n_features, weight, score and rank: the ranks, from 1, of the floor(percent * N / 100)
    highest scores of the N documents with at least `least_words` words, ties to the smaller key; null for all others. score is the weight
    and a Gumbel noise that the key decides, so that the drawn are a sample in proportion to exp(weight / 1000), without replacement."""
    rows = weighed(docs, gains(docs, target, n, buckets, text, target_text), n, text)
    column = F.col(f"row.{quoted(key)}")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("place", F.when(F.col("n_words") >= least_words, F.col("score")))
    rows = written(rows, "weighed")
    # at most 200,000 rows, see above: one task orders them, and they may be sent to all
    every = Window.orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.where("place is not null").groupBy("place").agg(F.count("*").alias("n"))
    above = counts.withColumns({"above": F.coalesce(F.sum("n").over(every), F.lit(0)), "draw": F.expr(f"{percent} * sum(n) over () div 100")}).drop("n")
    rows = rows.join(F.broadcast(above), "place", "left").withColumn("in", F.coalesce(F.col("above") < F.col("draw"), F.lit(False)))
    ties = Window.partitionBy("place").orderBy(column.asc_nulls_last())
    drawn = rows.where(F.col("in")).withColumn("rank", F.col("above") + F.row_number().over(ties))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("draw"), F.col("rank")).cast("bigint"))
    rest = rows.where(~F.col("in")).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select("row", "n_words", "n_features", "weight", "score", "rank")
