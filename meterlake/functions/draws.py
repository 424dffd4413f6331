"""Repeatable pseudo-random numbers from labels, and whole-number splits by weight."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*label: Column | str) -> Column:
    """A number in [0, 1) from the md5 of a label: 52 bits, the same in any engine, and no state."""
    parts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in label]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def between(u: Column, low: Column, high: Column) -> Column:
    """A whole number from low to high by a uniform number."""
    return F.when(high <= low, low).otherwise(low + F.floor(u * (high - low + 1))).cast("bigint")


def jittered(base: Column, ratio: float, u: Column) -> Column:
    return F.round(base * (F.lit(1.0 - ratio) + u * F.lit(2 * ratio))).cast("bigint")


def bound(expr: Column, body) -> Column:
    """body(value of expr), with expr evaluated once a row, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))


def split(total: Column, weights: Column, least: int) -> Column:
    """array<bigint> of parts of a total by weight: each gets `least` if all can, then its rounded share of what is left, the last the rest."""
    return bound(F.struct(total.cast("bigint").alias("total"), weights.alias("weights")), lambda x: _split(x["total"], x["weights"], least))


def _split(total: Column, weights: Column, least: int) -> Column:
    n = F.size(weights)
    base = F.when(total >= n * least, F.lit(least)).otherwise(F.lit(0)).cast("bigint")
    kind = "struct<left:bigint,weight:double,out:array<bigint>>"
    start = F.struct((total - base * n).alias("left"), F.aggregate(weights, F.lit(0.0), lambda a, w: a + w).alias("weight"), F.array().cast("array<bigint>").alias("out")).cast(kind)

    def step(s: Column, w: Column) -> Column:
        share = F.when(F.size(s["out"]) == n - 1, s["left"]).otherwise(F.least(s["left"], F.round(s["left"].cast("double") * w / s["weight"]).cast("bigint")))
        grown = lambda x: F.struct((s["left"] - x).alias("left"), (s["weight"] - w).alias("weight"), F.concat(s["out"], F.array(base + x)).alias("out")).cast(kind)
        return bound(share, grown)

    return F.aggregate(weights, start, step, lambda s: s["out"])


def uniforms(labels: list[str], items: list[str]) -> np.ndarray:
    """`uniform` of each label and item, joined as there, as a table: a row a label, a column an item."""
    ends = [f"|{item}".encode() for item in items]
    digests = b"".join([hashlib.md5(begin + end).digest() for begin in map(str.encode, labels) for end in ends])
    return ((np.frombuffer(digests, ">u8")[::2] >> 12) / float(1 << 52)).reshape(len(labels), len(items))


def splits(totals: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
    """`split` of many totals, none negative, by a row of weights each, with its sums and roundings in the same order."""
    n = weights.shape[1]
    base = np.where(totals >= n * least, least, 0)
    left, weight, out = totals - base * n, np.zeros(len(totals)), np.empty(weights.shape, "int64")
    for i in range(n):
        weight += weights[:, i]
    for i in range(n - 1):
        exact = left * weights[:, i] / weight
        whole = np.floor(exact)
        share = np.minimum(left, (whole + (exact - whole >= 0.5)).astype("int64"))
        out[:, i], left, weight = base + share, left - share, weight - weights[:, i]
    out[:, n - 1] = base + left
    return out
