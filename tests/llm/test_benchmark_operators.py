"""Operators that hold the documents against the benchmark: ranked search, importance resampling, decontamination."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, importance, ranked_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def tangled(spark):
    """Texts of few words, so that everything repeats: copies, ties, nulls, repeated rows and ids, and a text longer than a slice's share."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "c9", "Ärger", "日本", "d-e"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, docs[3][1]), (204, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (205, text(4000))]
    items = [(i, text(rng.randrange(9, 25))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "c9 b"), (23, "nowhere to be found"), items[4], (24, items[4][1]), (None, items[2][1]), (25, docs[7][1] + " a a b"), (26, "a a a a b")]
    return docs, items


def frames(spark, tangled):
    docs, items = tangled
    clashes = {"row": 1, "rank": 2, "spans": 3, "items": 4, "n_words": 5, "score": 6, "x`y.z": 7}
    left = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({k: F.lit(v) for k, v in clashes.items()})
    return left.repartition(5), spark.createDataFrame(items, "item_id bigint, text string").repartition(3)


def test_terms_equal_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB9é日 \n-_\x00\x7fzZ@[`{") for _ in range(rng.randrange(40))) for _ in range(800)] + ["", "x" * 700_000 + " y", "", "Tail"]
    raw = [t.encode() for t in texts]
    at = np.r_[0, np.cumsum([len(b) for b in raw])]
    seen, rows = {}, []
    for i, j in terms.whole_texts(at, 5000):
        t = terms.terms(np.frombuffer(b"".join(raw), np.uint8), at[i : j + 1])
        hashes = t.hashes()
        for k in range(j - i):
            rows.append([t.term(x).decode() for x in range(t.first[k], t.first[k + 1])])
        assert all(seen.setdefault(t.term(x), h) == h for x, h in enumerate(hashes.tolist()))
    assert rows == [words(t) for t in texts] and len(set(seen.values())) == len(seen)


def brute_search(docs, items, top):
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    bags = [b for b in bags if b[2]]
    n, length = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    weight = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in set(items):
        scored = []
        for d, bag, size in bags:
            m = 75 + (25 * size * n) // length
            score = sum(weight(t) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in words(text) if t in bag)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"block": 40}])
def test_search_equals_brute_force(spark, tangled, options):
    docs, items = frames(spark, tangled)
    got = ranked_search.search(docs, items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(*tangled, options.get("top", 20))


def test_search_of_empty_tables(spark, tangled):
    docs, items = frames(spark, tangled)
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


def test_best_candidates_are_reduced_block_by_block(monkeypatch, spark, tangled):
    monkeypatch.setattr(ranked_search, "KEPT", 1)
    t = ranked_search.best(np.array([1, 0, 1, 1, 0]), np.array([5, 7, 9, 5, 7]), pa.array([4, 3, 2, 1, None]), 2)
    assert t.to_pydict() == {"item": [0, 0, 1, 1], "score": [7, 7, 9, 5], "doc_id": [3, None, 2, 1]}


def brute_weights(docs, items, n, buckets):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for _, text in rows for b in features(text)) for rows in (docs, items))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    return [(d, len(words(x)), len(f), sum(gain[b] for b in f) // len(f) if f else 0) for d, x in docs for f in [features(x)]]


@pytest.mark.parametrize("n,buckets,percent", [(1, 10_000, 10), (3, 50, 40)])
def test_resampling_equals_brute_force(spark, tangled, n, buckets, percent):
    docs, items = frames(spark, tangled)
    got = importance.resampled(docs, items, n=n, buckets=buckets, percent=percent)
    assert got.schema["row"].dataType.fieldNames() == [c for c in docs.columns if c != "text"]
    want = []
    for d, size, features, weight in brute_weights(*tangled, n, buckets):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append((d, size, features, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0] or 0))
    rows = [tuple(r) for r in got.select("row.doc_id", "n_words", "n_features", "weight", "score").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    ranked = [(r.doc_id, r.score, r.rank) for r in got.where("rank is not null").select("row.doc_id", "score", "rank").orderBy("rank").collect()]
    assert ranked == [(w[0], w[4], k + 1) for k, w in enumerate(order[: percent * len(order) // 100])]


def test_resampling_of_empty_tables(spark, tangled):
    docs, items = frames(spark, tangled)
    assert importance.resampled(docs.limit(0), items).count() == 0
    rows = importance.resampled(docs, items.limit(0))
    assert rows.count() == docs.count()
    blank = docs.where("text = ''")
    assert importance.resampled(blank, items).where("rank is null and weight = 0 and n_features = 0").count() == blank.count() > 0


def test_a_trie_holds_counts_and_the_state_of_each_path():
    raw = "a bc a bc a".encode()
    t = terms.terms(np.frombuffer(raw, np.uint8), np.array([0, 7, len(raw)]))  # "a bc a " and "bc a"
    got = [Counter(dict(zip(state.tolist(), count.tolist(), strict=True))) for state, count, _, _ in importance.levels(t, 3)]
    crc = lambda *pairs: Counter({zlib.crc32(x): n for x, n in pairs})
    assert got == [crc((b"a", 3), (b"bc", 2)), crc((b"a bc", 1), (b"bc a", 2)), crc((b"a bc a", 1))]


def brute_marks(docs, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, met = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    met |= found
        names = sorted(str(m) for m in met - {None})
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"window": 4}, {"window": 2}, {"block": 30}])
def test_marks_equal_brute_force(spark, tangled, options, monkeypatch):
    docs, items = frames(spark, tangled)
    got = decontaminate.report(decontaminate.marks(docs, items, **options)).select("doc_id", *decontaminate.MADE)
    want = brute_marks(*tangled, options.get("window", 10))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = decontaminate.decontaminated(docs, items, **options)
    assert kept.columns == docs.columns
    texts = Counter((d, t) for d, t in tangled[0])
    assert sum(texts.values()) == len(want) and kept.count() == sum(not w[5] for w in want)


def test_long_items_are_searched_by_segments(spark, tangled, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 7)
    docs, items = tangled
    _, spark_items = frames(spark, tangled)
    parts = [decontaminate._segments(10)(iter([pa.RecordBatch.from_arrays([pa.array([str(i) for i, _ in items]), pa.array([t for _, t in items])], ["item", "text"])]))]
    rows = [r for batch in parts[0] for r in batch.to_pylist()]
    index = decontaminate.Index([(r["item"], r["at"], r["whole"], r["words"]) for r in rows], 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([t for _, t in docs], pa.string()), pa.array([0] * len(docs)), pa.array([None] * len(docs), pa.list_(pa.int64())), pa.array([None] * len(docs), pa.list_(pa.int64()))], list("abcde"))
    out = next(iter(decontaminate._marked(index, False)(iter([batch]))))
    hits = [sum(s["hi"] - s["lo"] for s in spans) for spans in out.column("spans").to_pylist()]
    want = {(d, n): h for d, n, h, *_ in brute_marks(docs, items, 10)}
    assert hits == [want[d, len(words(t))] for d, t in docs]


def test_longest_matches_equal_brute_force(spark, tangled):
    docs, items = frames(spark, tangled)
    items = items.where("item_id < 22").dropDuplicates(["item_id"])
    got = {(r.item, r.at): (r.words, r.doc_id, r.doc_at) for r in decontaminate.longest_matches(docs, items, window=4).collect()}
    texts = [(d, words(t)) for d, t in tangled[0]]
    for item, text in ((r.item_id, r.text) for r in items.collect()):
        w = words(text)
        for i in range(len(w) - 3):
            best = 0
            for _, other in texts:
                for j in range(len(other)):
                    k = 0
                    while i + k < len(w) and j + k < len(other) and w[i + k] == other[j + k]:
                        k += 1
                    best = max(best, k)
            if best < 4:
                assert (str(item), i) not in got
                continue
            n, d, j = got.pop((str(item), i))
            assert n == best and any(d == e and other[j : j + n] == w[i : i + n] for e, other in texts)
    assert not got


def test_a_suffix_array_is_in_order():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += texts[:20]  # copies tie to any depth
    raw = "".join(texts).encode()
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    items = [("x", 0, True, " ".join(rng.choice("ab") for _ in range(40))), ("y", 0, True, "a b c")]
    index = decontaminate.Index(items, 3)
    shard = decontaminate.Shard.of(terms.terms(np.frombuffer(raw, np.uint8), at), index)
    tail = lambda p: shard.words[p : p + np.argmin(np.r_[shard.words, 0][p:])].tolist()[: index.depth]
    suffixes = [tail(p) for p in shard.order]
    assert suffixes == sorted(suffixes) and len(set(shard.order.tolist())) == len(suffixes)


@pytest.mark.parametrize("operator", [decontaminate.marks, decontaminate.longest_matches, importance.resampled, ranked_search.search])
def test_empty_items_and_documents(spark, tangled, operator):
    docs, items = frames(spark, tangled)
    operator(docs.limit(0), items).collect()
    operator(docs, items.limit(0)).collect()
