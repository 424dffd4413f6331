"""Ranked lexical search as a blocked sparse matrix product: item-term multiplicities times term-document impacts.

A first pass writes the term-document matrix, for the items' terms only: a row a document, with its number of terms of any kind, and the
numbers and frequencies of the items' terms. From it come the corpus' statistics over all documents. A block of the product is what one Arrow
batch of such rows holds: its postings are turned into rows of the matrix by term, with integer impacts, and for each item the rows of its
terms are merged by Gustavson's scheme, each row, times the term's multiplicity, added to one dense row of scores. Of each row of scores only
the best `top` go on: they are reduced block by block in a task, then over neighbouring tasks, then over all, so no task ever meets more than
`top` rows an item from each of a bounded number of tasks.

All sums are int64; only a term's weight is made of doubles. Items come in blocks of about BLOCK terms, each a pass of its own, so that a
task holds no more of them, and the driver holds one block while its pass is planned. Hashes of 64 bits find a term, its bytes prove it.

Null and empty texts have no terms: as documents they don't count, as items they have no answers. Rows of equal item id and text are one item.
Equal scores go by ascending document id, null ids last; rows of one document id are ranked each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written
from .fingerprints64 import text_parts
from .terms import found, same_bytes, terms, whole_texts

TOP = 20
BLOCK = 1 << 20
#: Tasks whose candidates are reduced together before all are.
NEIGHBOURS = 256
#: Candidates that a task keeps before it reduces them.
KEPT = 1 << 18


class Items:
    """A block of items: ids as strings, their distinct terms, and the multiplicities as rows of a sparse matrix."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))
        raw = [r[1].encode("utf-8", "surrogatepass") for r in rows]
        at = np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)
        t = terms(np.frombuffer(b"".join(raw), np.uint8), at)
        self.known, first, number = np.unique(t.hashes(), return_index=True, return_inverse=True)
        size = t.hi - t.lo
        if not (size == size[first][number]).all() or not same_bytes(t.buf, t.lo, t.buf, t.lo[first][number], size).all():
            raise ValueError("two terms of the items have one hash")
        self.ids = [r[0] for r in rows]
        self.bytes, self.lo, self.size = t.buf, t.lo[first], size[first]
        item = np.repeat(np.arange(len(rows)), np.diff(t.first))
        cell, self.times = np.unique(item * max(1, len(self.known)) + number, return_counts=True)
        self.term = cell % max(1, len(self.known))
        self.rows = np.searchsorted(cell, np.arange(len(rows) + 1) * max(1, len(self.known)))


def _matrix(items: Items):
    def run(batches):
        v = max(1, len(items.known))
        for batch in batches:
            data, at = text_parts(batch.column(1))
            sizes, counts, numbers, times = [], [], [], []
            for i, j in whole_texts(at):
                t = terms(data, at[i : j + 1])
                sizes.append(np.diff(t.first))
                number = found(t.hashes(), items.known)
                doc = np.repeat(np.arange(j - i), sizes[-1])
                met = np.flatnonzero(number >= 0)
                size = t.hi[met] - t.lo[met]
                met = met[size == items.size[number[met]]]
                met = met[same_bytes(t.buf, t.lo[met], items.bytes, items.lo[number[met]], t.hi[met] - t.lo[met])]
                cell, tf = np.unique(doc[met] * v + number[met], return_counts=True)
                counts.append(np.bincount(cell // v, minlength=j - i))
                numbers.append(cell % v)
                times.append(tf)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, counts, numbers, times)]
            offsets = pa.array(np.r_[0, np.cumsum(flat[1])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in zip(flat[2:], (pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat[0], pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return run


def best(item: np.ndarray, score: np.ndarray, ids: pa.Array, top: int) -> pa.RecordBatch:
    """The best `top` candidates of each item, by score, then id."""
    table = pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), ids], ["item", "score", "doc_id"])
    table = table.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    item = table.column(0).to_numpy()
    first = np.searchsorted(item, item)
    return table.filter(pa.array(np.arange(len(item)) - first < top))


def product(items: Items, weight: np.ndarray, n: np.ndarray, docs: int, length: int, at: np.ndarray, number: np.ndarray, tf: np.ndarray, ids: pa.Array, top: int) -> pa.RecordBatch:
    """A block: (item, score, doc_id) of each item's best documents of a batch, whose rows of the matrix are parted by `at`."""
    m = np.array([100 - 25 + 25 * x * docs // length for x in n.tolist()], np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(at))
    impact = weight[number] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    by_term = np.argsort(number, kind="stable")
    doc, impact = doc[by_term], impact[by_term]
    edges = np.searchsorted(number[by_term], np.arange(len(items.known) + 1))
    of, scores, places = [], [], []
    row = np.zeros(len(n), np.int64)
    for i in range(len(items.ids)):
        row[:] = 0
        for k in range(items.rows[i], items.rows[i + 1]):
            a, b = edges[items.term[k]], edges[items.term[k] + 1]
            row[doc[a:b]] += items.times[k] * impact[a:b]
        hit = np.flatnonzero(row > 0)
        if len(hit) > top:  # all that tie with the last place stay for now
            hit = hit[row[hit] >= np.partition(row[hit], len(hit) - top)[len(hit) - top]]
        of.append(np.full(len(hit), i))
        scores.append(row[hit])
        places.append(hit)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return best(np.concatenate(of) if of else place, np.concatenate(scores) if scores else place, ids.take(pa.array(place)), top)


def _multiplied(items: Items, weight: np.ndarray, docs: int, length: int, top: int):
    names = pa.array(items.ids, pa.string())

    def run(batches):
        kept: list[pa.RecordBatch] = []

        def reduced() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept).combine_chunks()
            column = t.column(2).combine_chunks()
            return best(t.column(0).to_numpy(), t.column(1).to_numpy(), column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, top)

        for batch in batches:
            lists, tf = batch.column(2), batch.column(3)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[at[0] : at[-1]].astype(np.int64), tf.values.to_numpy()[tf.offsets[0].as_py() : tf.offsets[-1].as_py()]
            kept.append(product(items, weight, batch.column(1).to_numpy(), docs, length, at - at[0], *flat, batch.column(0), top))
            if sum(len(b) for b in kept) > max(KEPT, 2 * top * len(items.ids)):
                kept = [reduced()]
        if kept:
            out = reduced()
            yield pa.RecordBatch.from_arrays([out.column(0), names.take(out.column(0)), out.column(2), out.column(1)], ["item", "item_id", "doc_id", "score"])

    return run


def _sized():
    def run(batches):
        for batch in batches:
            data, at = text_parts(batch.column(1))
            n = [np.diff(terms(data, at[i : j + 1]).first) for i, j in whole_texts(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], ["item_id", "text", "n"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """Each item's `top` documents of the highest scores above 0: (item_id, rank, doc_id, score)."""
    asked = items.select(F.col(quoted(item)).alias("item_id"), F.coalesce(F.col(quoted(item_text)), F.lit("")).alias("text")).distinct()
    kind = dict(asked.dtypes)["item_id"]
    asked = asked.select(F.col("item_id").cast("string"), "text").mapInArrow(_sized(), "item_id string, text string, n bigint").where("n > 0")
    asked = written(asked, "items", release=False)
    blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // block))
    rows = docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    id_kind = dict(rows.dtypes)["doc_id"]
    parts = []
    for b in range(blocks):
        held = Items([(r["item_id"], r["text"]) for r in asked.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).collect()])
        matrix = rows.mapInArrow(_matrix(held), f"doc_id {id_kind}, n bigint, terms array<int>, tf array<bigint>").where("n > 0")
        matrix = written(matrix, "matrix")
        count, length = matrix.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(held.known), np.int64)
        for term, n in matrix.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many as the block has terms
            df[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found_ = matrix.where(F.size("terms") > 0).mapInArrow(_multiplied(held, weight, count, length or 1, top), f"item bigint, item_id string, doc_id {id_kind}, score bigint")
        parts.append(found_.withColumn("block", F.lit(b)).withColumn("near", F.floor(F.spark_partition_id() / NEIGHBOURS)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (("block", "item", "near"), ("block", "item")):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
