"""Quality scores by positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled good; the unlabelled set is a sample of all documents. With a class prior p the risk of a scorer f is
p * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - p * E_pos[loss(-f)]): the second part is the risk on the unseen negatives, which can't be
negative; where a batch makes it so, the step goes the other way, so that the scorer doesn't learn the positives by heart. The loss is the
logistic one, and the score is the probability of being good. f is a small network over measurements of the whole text.

The prior is estimated as the share of good ones among the labelled rows that may be used. Positives and unlabelled documents are bounded
samples picked by a hash; the measurements, not the texts, reach the driver.

Cases: null texts count as empty; an empty text has the score of its measurements, all zero; without a positive every score is the prior; one
row out for each row in; a document with several labels counts as good if all say so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row, with_row
from .fingerprints64 import text_parts, whole_texts
from .shingles import shingles, words

#: Rows of each kind that the scorer is fitted on, about.
SAMPLE = 8000
THRESHOLD = 0.7
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 3000, 512, 0.01, 1e-4

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~_=+\\/{}[]",
    "bar": b"|",
    "stop": b".",
    "comma": b",;:",
    "mark": b"!?",
    "quote": b"\"'()`-",
    "line": b"\n",
    "wide": bytes(range(128, 256)),
}


def measure(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """texts x measurements, of texts that lie one after the other."""
    n, base = len(starts), int(starts[0])
    buf = data[base : int(ends[-1])]
    size = (ends - starts).astype(float)
    kind = np.full(256, len(CLASSES), np.int64)
    for i, chars in enumerate(CLASSES.values()):
        kind[list(chars)] = i
    text_of = np.repeat(np.arange(n), ends - starts)
    counts = np.bincount(text_of * (len(CLASSES) + 1) + kind[buf], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)[:, :-1]
    shares = counts / np.maximum(size, 1)[:, None]
    out = [np.log1p(size) / 10, *np.log1p(30 * shares).T]
    if len(buf):
        lo, hi, text, h = words(data, starts, ends)
    else:
        lo, hi, text, h = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    m = np.bincount(text, minlength=n).astype(float)
    per = np.maximum(m, 1)
    share = lambda flag: np.bincount(text[flag], minlength=n) / per
    length = hi - lo
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    first, last = kind[buf[lo]] if len(lo) else np.zeros(0, int), kind[buf[hi - 1]] if len(hi) else np.zeros(0, int)
    names = list(CLASSES)
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct_words = np.bincount(text[order][new], minlength=n) / per
    owner, grams = shingles(text, h, n, 3) if len(h) else (np.zeros(0, int), np.zeros(0, np.uint64))
    order = np.lexsort((grams, owner))
    new = np.ones(len(grams), bool)
    new[1:] = (grams[order][1:] != grams[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct_grams = np.bincount(owner[order][new], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
    out += [np.log1p(m) / 8, np.bincount(text, length, n) / per / 10, share(length <= 2), share(length >= 14), np.log1p(30 * share(same)), distinct_words, distinct_grams]
    out += [np.log1p(30 * share(first == names.index("upper"))), np.log1p(30 * share(last == names.index("symbol"))), np.log1p(30 * share(last == names.index("mark")))]
    out += [np.log1p(30 * share((last == names.index("stop")) | (last == names.index("comma")))), np.log1p(30 * share((length == 1) & (first == names.index("bar"))))]
    return np.stack(out, 1)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class Scorer:
    """One hidden layer over scaled measurements."""

    def __init__(self, columns: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(columns), np.ones(columns)
        self.w = [rng.normal(0, 1 / np.sqrt(columns), (columns, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w[0] + self.w[1])
        return (hidden @ self.w[2] + self.w[3])[:, 0], hidden

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.raw(self.scaled(x))[0]) if len(x) else np.zeros(0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Scorer:
    """The scorer of least non-negative risk."""
    out = Scorer(unlabelled.shape[1], seed)
    if not len(positive) or not len(unlabelled):
        out.w = [np.zeros_like(w) for w in out.w]
        out.w[3][:] = np.log(prior / (1 - prior))
        return out
    out.mean, out.scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    p, u = out.scaled(positive), out.scaled(unlabelled)
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(w) for w in out.w], [np.zeros_like(w) for w in out.w]
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.r_[xp, xu]
        z, hidden = out.raw(x)
        zp, zu = z[: len(xp)], z[len(xp) :]
        risk_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # derivatives of log(1 + e^z) and log(1 + e^-z)
        up, uu = _logistic(zp), _logistic(zu)
        good, bad = np.r_[prior * (up - 1) / len(xp), np.zeros(len(xu))], np.r_[-prior * up / len(xp), uu / len(xu)]
        dz = (good + bad if risk_negative >= 0 else -bad)[:, None]
        back = dz @ out.w[2].T * (1 - hidden**2)
        grads = [x.T @ back + DECAY * out.w[0], back.sum(0), hidden.T @ dz + DECAY * out.w[2], dz.sum(0)]
        rate = RATE * (1 - step / (STEPS + 1))
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            out.w[i] = out.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return out


def _measured(batches):
    for batch in batches:
        data, at = text_parts(batch.column(1))
        found = [measure(data, s, e) for _, _, s, e in whole_texts(at)]
        flat = np.concatenate(found) if found else np.zeros((0, 1))
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(flat) + 1) * flat.shape[1]).astype(np.int32)), pa.array(flat.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["positive", "x"])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", sample: int = SAMPLE) -> Scorer:
    """Fits a scorer on documents (key, text) and labels (key, quality), of the rows whose key is allowed."""
    known = labels.where(allowed & F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"))
    total, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1)), F.lit(0))).first()
    prior = float(np.clip(good / total, 0.05, 0.98)) if total else 0.5
    n = docs.count()
    lot = lambda seed, of: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int((sample << 20) / max(1, of)) + 1
    # about `sample` keys
    picked = known.where((F.col("quality") == 1) & lot(1, good)).select(key, F.lit(True).alias("positive"))
    rows = docs.where(allowed).select(key, "text", lot(2, n).alias("unlabelled")).join(F.broadcast(picked), key, "left").where("positive or unlabelled")
    # a document in both samples comes twice
    twice = rows.select(F.explode(F.array_compact(F.array(F.when(F.col("positive"), F.lit(True)), F.when(F.col("unlabelled"), F.lit(False))))).alias("positive"), F.coalesce("text", F.lit("")).alias("text"))
    table = twice.mapInArrow(_measured, "positive boolean, x array<double>").toArrow()
    x = table.column("x").combine_chunks()
    columns = measure(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)).shape[1]
    values = x.flatten().to_numpy().reshape(-1, columns) if table.num_rows else np.zeros((0, columns))
    positive = np.array(table.column("positive").to_pylist(), bool)
    order = np.lexsort((*values.T[::-1], positive))  # whatever order the rows came in
    values, positive = values[order], positive[order]
    return fit(values[positive], values[~positive], prior)


def _scored(scorer: Scorer):
    def run(batches):
        for batch in batches:
            data, at = text_parts(batch.column(1))
            found = [scorer(measure(data, s, e)) for _, _, s, e in whole_texts(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["row", "score"])

    return run


def score(docs: DataFrame, scorer: Scorer, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with score; without the text unless keep_text says otherwise."""
    rows = docs.select(whole_row(docs, "score", *[] if keep_text else [text]).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(_scored(scorer), with_row(rows, "score double")).select("row.*", "score")
