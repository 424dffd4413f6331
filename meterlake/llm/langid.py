"""Language identification by unigram piece models that sum over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over all ways to cut it
into pieces, of the product of the pieces' probabilities; the forward algorithm adds them up position by position. Words are runs of
letters in lower case. A text's score in a language is the sum over its words. Probabilities are learned by expectation maximisation from
a bounded sample of labelled texts: forward and backward sums give the expected uses of each piece.

Pieces never cross words, so each distinct word is summed once for all languages, words of equal length together. A word of any length is
one word: sums are scaled on the way and their logarithms kept, so a long run of letters (a script without spaces) does not underflow.

Cases: null texts and texts without a letter are `und` with score 0; without training rows every text is `und`; whole texts are read; of
equally likely languages the first by name is taken; equal texts have equal results, one row out for each row in; an input's own columns are
kept whatever their names, but for lang_pred and score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row, with_row
from .pieces import MODEL, Vocabulary, batches_of, by_length, code_points, distinct_words, hashed_all, prefixes, split_words, vocabulary

#: Documents of a language that its model is fitted on, about; and rounds of expectation maximisation.
SAMPLE = 400
ROUNDS = 4
SMOOTHING = 0.1
#: What a character that no piece covers is worth.
UNKNOWN = 1e-7
#: Sums are scaled every so many letters: what a letter is worth at least, to this power, is no smaller than a float can hold.
RESCALE = 32
#: Distinct words that a task remembers.
MEMORY = 1 << 19
UND = "und"

LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    """Words of letters in lower case, one space between."""
    return " ".join(LETTERS.findall(text.lower()))


class Matches:
    """All pieces in words of equal length, by end and word: rows, lengths, piece ids, and where each run of one end and word starts."""

    def __init__(self, chars: np.ndarray, vocab: Vocabulary):
        (m, n), sums = chars.shape, prefixes(chars)
        rows, ends, size, ids = [], [], [], []
        for k in range(1, min(n, vocab.longest) + 1):
            hit, found = vocab.find(hashed_all(sums, k).ravel())
            rows.append(hit // (n - k + 1))
            ends.append(hit % (n - k + 1) + k)
            size.append(np.full(len(hit), k))
            ids.append(found)
        rows, ends, size, ids = (np.concatenate(x) for x in (rows, ends, size, ids))
        order = np.lexsort((rows, ends))
        self.rows, self.ends, self.size, self.ids = rows[order], ends[order], size[order], ids[order]
        self.cut = np.searchsorted(self.ends, np.arange(n + 2))
        self.n, self.m, self.longest = n, m, vocab.longest

    def at(self, e: int):
        s = slice(self.cut[e], self.cut[e + 1])
        return self.rows[s], self.size[s], self.ids[s]


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of sorted rows, and their sums."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[first], np.add.reduceat(values, first, axis=0)


def forward(found: Matches, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words x (length + 1) x languages: summed probabilities of the prefixes, scaled, and the logarithms of the scales. prob: pieces x
    languages."""
    alpha, scale = np.zeros((found.m, found.n + 1, prob.shape[1])), np.zeros((found.m, found.n + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    for e in range(1, found.n + 1):
        alpha[:, e] = alpha[:, e - 1] * UNKNOWN
        rows, size, ids = found.at(e)
        if len(rows):
            r, total = _summed(rows, alpha[rows, e - size] * prob[ids])
            alpha[r, e] += total
        if e % RESCALE == 0:
            first = max(0, e - found.longest + 1)  # what later places look back to
            by = alpha[:, first : e + 1].max(1, keepdims=True)
            alpha[:, first : e + 1] /= by
            scale[:, first:] += np.log(by)
    return alpha, scale


def backward(found: Matches, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for suffixes."""
    beta, scale = np.zeros((found.m, found.n + 1, prob.shape[1])), np.zeros((found.m, found.n + 1, prob.shape[1]))
    beta[:, found.n] = 1.0
    order = np.lexsort((found.rows, found.ends - found.size))
    rows, ends, ids = found.rows[order], found.ends[order], found.ids[order]
    cut = np.searchsorted((found.ends - found.size)[order], np.arange(found.n + 2))
    for b in range(found.n - 1, -1, -1):
        beta[:, b] = beta[:, b + 1] * UNKNOWN
        s = slice(cut[b], cut[b + 1])
        if s.stop > s.start:
            r, total = _summed(rows[s], beta[rows[s], ends[s]] * prob[ids[s]])
            beta[r, b] += total
        if (found.n - b) % RESCALE == 0:
            last = min(found.n, b + found.longest - 1)
            by = beta[:, b : last + 1].max(1, keepdims=True)
            beta[:, b : last + 1] /= by
            scale[:, : last + 1] += np.log(by)
    return beta, scale


def fit(words: dict[str, dict[str, int]], vocab: Vocabulary, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and probabilities pieces x languages, from counts of words by language."""
    langs = sorted(words)
    prob = np.full((len(vocab.pieces), len(langs)), 1.0 / max(1, int(vocab.usable.sum())))
    every = sorted(set().union(*words.values())) if langs else []
    count = np.array([[words[x].get(w, 0) for x in langs] for w in every], float).reshape(len(every), len(langs))
    chars, at = code_points(every)
    groups = [(g, Matches(chars[at[g][:, None] + np.arange(n)], vocab)) for n, g in by_length(at[:-1], at[1:], 1 << 17)]
    for _ in range(rounds):
        expected = np.zeros_like(prob)
        for g, found in groups:
            (alpha, a), (beta, b) = forward(found, prob), backward(found, prob)
            rows, start = found.rows, found.ends - found.size
            total = np.log(alpha[:, -1]) + a[:, -1]
            share = alpha[rows, start] * prob[found.ids] * beta[rows, found.ends] * np.exp(a[rows, start] + b[rows, found.ends] - total[rows])
            np.add.at(expected, found.ids, share * count[g[rows]])
        expected[vocab.usable] += SMOOTHING
        prob = expected / expected.sum(0)
    return langs, prob


class Scorer:
    """Log-probabilities of distinct words, remembered within a task up to a bound."""

    def __init__(self, vocab: Vocabulary, prob: np.ndarray):
        self.vocab, self.prob = vocab, prob
        self.forget()

    def forget(self) -> None:
        self.seen, self.value = np.zeros(0, np.uint64), np.zeros((0, self.prob.shape[1]), np.float32)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages: log-probabilities; and how many words each text has."""
        chars, at = code_points(texts)
        if not len(chars):
            return np.zeros((len(texts), self.prob.shape[1])), np.zeros(len(texts), np.int64)
        lo, hi = split_words(chars, at)
        keys, first, which = distinct_words(chars, lo, hi)
        place = np.searchsorted(self.seen, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.seen)
        known[inside] = self.seen[place[inside]] == keys[inside]
        value = np.zeros((len(keys), self.prob.shape[1]), np.float32)
        value[known] = self.value[place[known]]
        new = np.flatnonzero(~known)
        starts, ends = lo[first[new]], hi[first[new]]
        for n, g in by_length(starts, ends, 1 << 17):
            alpha, scale = forward(Matches(chars[starts[g][:, None] + np.arange(n)], self.vocab), self.prob)
            value[new[g]] = np.log(alpha[:, n]) + scale[:, n]
        if len(new):
            if len(self.seen) + len(new) > MEMORY:
                self.forget()
            seen, kept = np.r_[self.seen, keys[new]], np.r_[self.value, value[new]]
            order = np.argsort(seen)
            self.seen, self.value = seen[order], kept[order]
        text = np.searchsorted(at, lo, side="right") - 1
        words = np.bincount(text, minlength=len(texts))
        return np.stack([np.bincount(text, value[which, x], len(texts)) for x in range(value.shape[1])], 1), words


def _predict(path: str, langs: list[str], ids: np.ndarray, rows: np.ndarray, rest: np.ndarray):
    def run(batches):
        vocab = vocabulary(path)
        prob = np.zeros((len(vocab.pieces), len(langs)))
        prob[vocab.usable] = rest
        prob[ids] = rows
        scorer = Scorer(vocab, prob)
        names = np.array([*langs, UND])
        for batch in batches:
            label, score = [], []
            for _, texts in batches_of(batch.column(1)):
                logs, words = scorer.texts([letters(t) for t in texts]) if langs else (np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64))
                best = logs.argmax(1)
                with np.errstate(under="ignore"):
                    posterior = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                label.append(np.where(words > 0, best, len(langs)))
                score.append(np.where(words > 0, posterior, 0.0))
            where = np.concatenate(label) if label else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[where].tolist(), pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], ["row", "lang_pred", "score"])

    return run


def train(docs: DataFrame, path: str = MODEL, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Fits the models on about `sample` whole texts of each language of docs (text, lang), picked by a hash of the text.

    Rows without a language or a text are left out. The driver receives the sample's word counts, a bound set by the parameter.
    """
    docs = docs.where("lang is not null and text is not null")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    picked = docs.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) < F.ceil(F.lit(float(sample << 20)) / F.col("n"))).select("lang", "text")

    def counted(batches):
        for batch in batches:
            out: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in letters(text).split():
                    out[lang, w] = out.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], ["lang", "word", "n"])

    words: dict[str, dict[str, int]] = {}
    for lang, word, n in picked.mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        words.setdefault(lang, {})[word] = n
    return fit(words, vocabulary(path))


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, path: str = MODEL, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score (the probability of lang_pred against the other languages)."""
    rows = docs.select(whole_row(docs, text, "lang_pred", "score").alias("row"), F.col(text).alias("text"))
    # pieces that no sample has share one value a language and stay out of what is sent to the tasks
    rest = prob[vocabulary(path).usable].min(0) if langs else np.zeros(0)
    ids = np.flatnonzero((prob > rest).any(1)) if langs else np.zeros(0, np.int64)
    return rows.mapInArrow(_predict(path, langs, ids, prob[ids], rest), with_row(rows, "lang_pred string, score double")).select("row.*", "lang_pred", "score")
