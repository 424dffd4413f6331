import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import dartminhash, html_text, imatch, langid, mixing, pieces, prefix_free, pu_quality, quality_rules, queries, sentencepiece_codec, sharding, suffix_dedup
from meterlake.llm.common import table
from meterlake.llm.graph import components

from .conftest import sha, words


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# sharding


def test_table_is_fair_and_stable():
    names = sharding.shard_names(16)
    table = sharding.fill_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 15)
    assert moved < 0.35 * 1009
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 7)


def test_placement(spark, sample):
    out = sharding.assign_shards(sample, sharding.shard_names(4), 101)
    assert out.count() == sample.count() and out.columns[-2:] == ["slot", "shard"]
    by = defaultdict(set)
    for r in out.collect():
        by[r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in by.values())
    assert sharding.assign_shards(sample.limit(0), sharding.shard_names(4), 101).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, str(tmp_path / "s"), sharding.shard_names(4), 101, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s")).toPandas()
    want = sharding.assign_shards(df, sharding.shard_names(4), 101).toPandas()
    assert dict(zip(back.doc_id, back.shard, strict=True)) == dict(zip(want.doc_id, want.shard, strict=True))
    assert want.shard.value_counts().max() < 1.2 * want.shard.value_counts().min()


# quality rules


def test_rules_on_small_texts(spark, sample):
    out = {(r.doc_id, r.text): r for r in quality_rules.judge(sample).collect()}
    for (_, text), r in out.items():
        w = words(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        marked = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(marked))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r.base_failed == (len(w) < 10 or 100 * len(marked) > 20 * len(w)) and not (r.base_failed and r.kept)
    rules = spark.createDataFrame([(1, "Home | About | Contact\n" + "A clean line of text stays here.\n" * 1 + "Another good line of words is here too."), (2, "BUY NOW!! CHEAP!! THINGS!! HERE!! FAST!!\n" * 1 + "SALE!! SALE!! EVERY!! DAY!! OF!! THE!! YEAR!!"), (3, "All rights reserved.\nOne good line with some words in it stays."), (4, "a$$ b&& c%% d## e** f$$ g&& h%% i## j**")], "doc_id bigint, text string")
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality_rules.judge(rules).collect()}
    assert got[1] == (True, "A clean line of text stays here.\nAnother good line of words is here too.")
    assert got[2] == (False, "") and got[4] == (False, "")
    assert got[3] == (True, "One good line with some words in it stays.")


# suffix dedup


def brute_repeats(rows, width):
    count, data = Counter(), [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for k, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((k, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,gap,seed", [(24, 12, 1), (20, 8, 2), (30, 22, 3)])
def test_repeats_equal_brute_force(spark, width, gap, seed):
    r, rows = random.Random(seed), []
    for i in range(200):
        t = "".join(r.choice("ab") for _ in range(r.randrange(60)))
        rows.append((i, t + (rows[r.randrange(len(rows))][1][5:60] if rows and r.random() < 0.5 else "")))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(suffix_dedup.remove_repeats(df, width, gap), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, width)


@pytest.mark.parametrize("seed", range(12))
def test_dictionary_and_parse_give_the_order_of_all_places(seed):
    """Suffix arrays of dictionary and parse, merged, against sorting the strings; texts that repeat each other, or are one letter long."""
    r, texts = random.Random(seed), []
    for _ in range(r.randrange(1, 25)):
        text = "".join(r.choice(["ab", "abcdefgh ", "a"][seed % 3]) for _ in range(r.randrange(8, 200)))
        texts.append(text[:5] + r.choice(texts)[3:] if texts and r.random() < 0.6 else text)
    data, n = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts])
    starts, ends, width = np.cumsum(n) - n, np.cumsum(n), r.choice([9, 12, 20, 40])
    places = np.concatenate([np.arange(a, max(a, b - width + 1)) for a, b in zip(starts, ends, strict=True)])
    order, same = prefix_free.corpus_order(data, starts, ends, places, width, r.choice([3, 5, 9]))
    found = [data[p : p + width].tobytes() for p in places[order]]
    assert found == sorted(found) and sorted(order.tolist()) == list(range(len(places)))
    assert same.tolist() == [i > 0 and found[i] == found[i - 1] for i in range(len(found))]
    parse = prefix_free.Parse(data, starts, ends, 5)
    phrases = {data[a : a + m].tobytes() for a, m in zip(parse.lead, parse.size, strict=True)}
    assert len(phrases) == len(parse.lead)
    for a, b, k in zip(parse.first, parse.end, parse.number, strict=True):
        assert data[a:b].tobytes() == data[parse.lead[k] : parse.lead[k] + parse.size[k]].tobytes()


def test_cores_are_ordered_in_packs_of_any_size():
    r = random.Random(9)
    base = [bytes(r.choices(b"abcd", k=60)) for _ in range(6)]
    rec, data = np.zeros(60, suffix_dedup.CONTEXT), []
    for i in range(60):
        rec[i] = (i % 7, i, 0, 30, suffix_dedup.REP if i % 11 == 0 else 0)
        data.append(r.choice(base)[: r.choice([40, 60])].ljust(60, bytes([97 + i % 3]))[:54])
    flat, width = np.frombuffer(b"".join(data), np.uint8), 24
    seen = Counter((i % 7, d[j : j + width]) for i, d in enumerate(data) for j in range(31))
    want = {(i, j) for i, d in enumerate(data) if i % 11 for j in range(31) if seen[i % 7, d[j : j + width]] > 1}
    # windows of other cores that happen to be equal count as well where cores share a pack; real cores are part of their windows
    for at_once in (1, 200, 1 << 20):
        which, start = suffix_dedup.repeated_windows(rec, flat, width, at_once)
        assert want <= set(zip(which.tolist(), start.tolist(), strict=True))
        if at_once == 1:
            assert want == set(zip(which.tolist(), start.tolist(), strict=True))


def test_repeats_on_odd_rows(spark, sample):
    plain = [(r.doc_id, r.text) for r in sample.collect()]
    out = suffix_dedup.remove_repeats(sample)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(plain, 200)
    assert {"slot", "row", "score"} <= set(out.columns)
    assert suffix_dedup.remove_repeats(sample.limit(0)).count() == 0


def test_repeats_across_tiles(spark, monkeypatch):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(9000))
    rows = [(1, text), (2, "head " + text[3000:8000] + " end"), (3, "z" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    data, at = (np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for _, t in rows])])
    tiles = list(suffix_dedup.slices(at, 199, 2048))
    assert sum(int(e[-1] - s[0]) for _, _, s, e, _ in tiles) > len(data)
    assert rows_of(suffix_dedup.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 200)


# near duplicates


def brute_classes(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            either = len(sets[i] | sets[j])
            if (either == 0) or both >= t * either - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[find(i)].append(k)
    return sorted((k, min(x for x in g if x is not None) if any(x is not None for x in g) else None) for g in groups.values() for k in g if k is not None)


def test_classes_equal_brute_force(spark):
    r, rows = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(400)]
    for base in range(6):
        original = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(25):  # from near copies to distant relatives, and a text that the family shares
            copy = [r.choice(vocabulary) if r.random() < r.choice([0, 0.005, 0.02, 0.04, 0.1]) else w for w in original]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(r.choice(vocabulary) for _ in range(80))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = dartminhash.classes(df)
    assert sorted((x.key, x.class_id) for x in out.collect()) == brute_classes(rows)
    kept = dartminhash.one_of_each(df)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in brute_classes(rows)})


def test_classes_on_odd_rows(spark, sample):
    plain = [(r.doc_id, r.text) for r in sample.collect()]
    out = dartminhash.classes(sample)
    assert out.count() == sample.count()
    assert sorted((x.key, x.class_id) for x in out.collect() if x.key is not None) == brute_classes(plain)
    kept = dartminhash.one_of_each(sample)
    assert kept.columns == sample.columns and kept.count() == out.select("class_id").distinct().count()
    assert dartminhash.classes(sample.limit(0)).count() == 0


def test_null_ids_join_no_classes(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(12))
    rows = [(None, text("a")), (5, text("a")), (None, text("b")), (7, text("b")), (None, text("c")), (None, text("d")), (None, text("d"))]
    out = dartminhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    groups = defaultdict(list)
    for r in out.collect():
        groups[r.class_id].append(r.key)
    assert sorted(len(v) for v in groups.values()) == [1, 2, 2, 2] and sorted(groups[5], key=str) == [5, None] and sorted(groups[7], key=str) == [7, None]


def test_parameters_keep_their_odds():
    assert dartminhash.rows_of_a_band(0.8) == 5
    for s in (0.4, 0.5, 0.7, 0.8, 0.95):
        r = dartminhash.rows_of_a_band(s)
        assert (1 - s**r) ** (150 // r) <= 1e-5
        at = dartminhash.least_agreeing(s, 150)
        assert (np.random.default_rng(1).binomial(150, s, 200_000) / 150 >= at).all() and at > s - 9 * math.sqrt(s * (1 - s) / 150)


def test_lower_similarity_and_exact_checks_equal_brute_force(spark):
    r, rows = random.Random(11), []
    for _ in range(4):
        original = [f"w{r.randrange(300)}" for _ in range(80)]
        rows += [(len(rows) + i, " ".join(w if r.random() > x else f"v{r.randrange(300)}" for w in original)) for i, x in enumerate([0, 0.03, 0.06, 0.1, 0.15] * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for exact in (False, True):
        out = dartminhash.classes(df, similarity=0.5, exact=exact)
        assert sorted((x.key, x.class_id) for x in out.collect()) == brute_classes(rows, 0.5)


def test_a_shingle_that_one_component_fills_is_dealt_out(spark, monkeypatch):
    """Two large groups that share rare shingles, and others beside them: every pair that may be similar is found, dealt or not."""
    rows = [(i, i % 3, 10, [(2 + (h % 4 > 0), h) for h in sorted([1, 2, *range(10 + i % 3, 18 + i % 3)])]) for i in range(60)]
    sets = spark.createDataFrame(rows, "node bigint, component bigint, size int, order array<struct<df:int,h:int>>")
    found = []
    for most in (256, 4):
        monkeypatch.setattr(dartminhash, "KEY_ROWS", most)
        found.append(rows_of(dartminhash.prefix_pairs(sets, 0.8), "a", "b"))
    pairs = {(a, b) for a in range(60) for b in range(a) if a % 3 != b % 3 and len({x for _, x in rows[a][3]} & {x for _, x in rows[b][3]}) / len({x for _, x in rows[a][3]} | {x for _, x in rows[b][3]}) >= 0.8}
    assert found[0] == found[1] and {(min(p), max(p)) for p in pairs} <= set(found[0])


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for trial in range(3):
        n = 200
        a, b = rng.integers(1, 9, n), rng.integers(1, 9, n)
        b = np.where(rng.random(n) < 0.6, a, b)
        found = []
        for _ in range(12):
            u = rng.integers(0, 2**63, n).astype(np.uint64)
            s = dartminhash.signatures(np.r_[np.zeros(n, int), np.ones(n, int)], np.r_[u, u], np.r_[a, b], 2, 150)
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_weighted_classes(spark):
    a = "a b c d e f g h i j " * 4
    rows = [(1, a), (2, "a b c d e f g h i j " * 9), (3, a + "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    by = lambda **how: {x.key: x.class_id for x in dartminhash.classes(df, **how).collect()}
    assert by()[2] == 1 and by(weighted=True) == {1: 1, 2: 2, 3: 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (205, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 205: 200}


# fingerprints


def test_fingerprints_of_edits(spark):
    r = random.Random(4)
    texts = {i: " ".join(f"t{min(int(r.expovariate(0.02)), 400)}" for _ in range(r.randrange(3, 200))) for i in range(150)}
    texts[150], texts[151], texts[152] = texts[3], "", "only rare words zzqq"
    rows = [(k, None if k == 151 else v) for k, v in texts.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = {x.doc_id: x for x in imatch.fingerprints(df).collect()}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        t, nxt = texts[k], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        assert out[k].n_chars == len(t) and out[k].edited_sha256 == sha((t[: len(t) - half] + nxt[:half]).encode())
        assert out[k].near_next == likeness(out[k].print, out[order[(i + 1) % len(order)]].print)
        assert out[k].near_edited == likeness(out[k].print, out[k].edited_print)
    assert out[150].print == out[3].print and out[151].print != out[152].print
    better = [x.near_edited > x.near_next for x in out.values() if x.n_chars > 100]
    assert np.mean(better) > 0.8
    assert imatch.fingerprints(df.limit(0)).count() == 0


def likeness(a, b):
    seen = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in seen) / len(seen) if seen else 0.0


def test_fingerprints_on_odd_rows(spark, sample):
    assert imatch.fingerprints(sample).count() == sample.count()


# pieces


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary()


def brute_pieces(text, vocab):
    if not text:
        return []
    ids = {p: i for i, p in enumerate(vocab.pieces) if vocab.usable[i]}
    s = "▁" + "".join({" ": "▁", "▁": "\U0010fffe"}.get(c, c) for c in text)
    unknown = vocab.scores[vocab.usable].min() - sentencepiece_codec.PENALTY
    best, back = [0.0] + [-1e18] * len(s), [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        best[e], back[e] = best[e - 1] + unknown, (1, None)
        for k in range(1, min(e, vocab.longest) + 1):
            i = ids.get(s[e - k : e])
            if i is not None and best[e - k] + vocab.scores[i] >= best[e]:
                best[e], back[e] = best[e - k] + vocab.scores[i], (k, i)
    out, e = [], len(s)
    byte = {int(b): i for i, b in enumerate(vocab.byte_of) if b >= 0}
    while e:
        k, i = back[e]
        out[:0] = [i] if i is not None else [byte[x] for x in ("▁" if s[e - 1] == "\U0010fffe" else s[e - 1]).encode()]
        e -= k
    return out


TEXTS = ["hello world", "", " two  spaces  ", "a▁b", "日本語のテスト 🤖 ok\nline\ttab", "x" * 300 + " " + "abc" * 50, "<0x41> <unk> <s>", "é" * 10, "   ", "\n", "a" * 97, "Ein schöner Tag für eine Wanderung " * 9]


def test_encoding_equals_brute_force(vocab):
    ids, at = sentencepiece_codec.encode(TEXTS, vocab)
    for i, t in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == brute_pieces(t, vocab), t[:30]
    assert [b.decode() for b in sentencepiece_codec.decode(ids, at, vocab)] == TEXTS


def test_round_trip_of_odd_rows(spark, sample):
    out = sentencepiece_codec.encode_documents(sample).collect()
    assert len(out) == sample.count() and all(r.round_trip for r in out)
    assert all(r.n_pieces == len(r.piece_ids) for r in out) and sentencepiece_codec.encode_documents(sample.limit(0)).count() == 0


# language


def brute_forward(word, prob, ids, unknown=langid.UNKNOWN):
    """Log of the sum over all segmentations of a word, in exact arithmetic, for each language."""
    s, out = "▁" + word, []
    for x in range(prob.shape[1]):
        p = [Fraction(float(v)) for v in prob[:, x]]
        total = [Fraction(1)]
        for e in range(1, len(s) + 1):
            ways = [total[e - k] * p[ids[s[e - k : e]]] for k in range(1, min(e, 24) + 1) if s[e - k : e] in ids]
            total.append(sum(ways, total[e - 1] * Fraction(unknown)))
        n = total[-1]
        out.append(math.log(n.numerator) - math.log(n.denominator))
    return np.array(out)


def test_forward_sums_all_segmentations(vocab):
    rng = np.random.default_rng(0)
    prob = rng.random((len(vocab.pieces), 2)) / 1000
    ids = {p: i for i, p in enumerate(vocab.pieces) if vocab.usable[i]}
    long = "".join(random.Random(3).choices("abcdehilnorstu", k=150)) + "日" * 70  # far below what a float holds
    for word in ("the", "über", "ab日", "hello", long):
        chars, _ = pieces.code_points([word])
        found = langid.Matches(chars[None, :], vocab)
        (alpha, a), (beta, b) = langid.forward(found, prob), langid.backward(found, prob)
        want = brute_forward(word, prob, ids)
        assert np.allclose(np.log(alpha[0, -1]) + a[0, -1], want, rtol=1e-10) and np.allclose(np.log(beta[0, 0]) + b[0, 0], want, rtol=1e-10)
        scorer = langid.Scorer(vocab, prob)
        assert np.allclose(scorer.texts([langid.letters(word)])[0][0], want, rtol=1e-5)


def test_training_equals_counting_all_segmentations(vocab):
    """One round of expectation maximisation, by listing each segmentation of each word."""
    words = {"xx": {"there": 3, "on": 1, "über": 2}, "yy": {"there": 1, "nine": 4}}
    ids = {p: i for i, p in enumerate(vocab.pieces) if vocab.usable[i]}

    def ways(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            for rest, p in ways(s[k:]):
                if s[:k] in ids:
                    yield (ids[s[:k]], *rest), p / vocab.usable.sum()
                if k == 1:
                    yield rest, p * langid.UNKNOWN

    langs, prob = langid.fit(words, vocab, rounds=1)
    for x, lang in enumerate(langs):
        expected = np.zeros(len(vocab.pieces))
        for w, n in words[lang].items():
            every = list(ways("▁" + w))
            for used_ids, p in every:
                np.add.at(expected, list(used_ids), n * p / sum(q for _, q in every))
        expected[vocab.usable] += langid.SMOOTHING
        assert np.allclose(prob[:, x], expected / expected.sum(), rtol=1e-9, atol=0)


def test_predictions_equal_naive_scores(spark, vocab):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").limit(40)
    langs, prob = langid.train(docs)
    ids = {p: i for i, p in enumerate(vocab.pieces) if vocab.usable[i]}
    rows = [r for r in docs.collect() if r.text and len(r.text) < 400][:6]
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), langs, prob).collect()}
    for r in rows:
        logs = sum((brute_forward(w, prob, ids) for w in langid.letters(r.text).split()), np.zeros(len(langs)))
        assert got[r.doc_id].lang_pred == langs[int(logs.argmax())]
        assert abs(got[r.doc_id].score - 1 / np.exp(logs - logs.max()).sum()) < 1e-3


def test_languages(spark, sample):
    words_of = {"xx": "lorem ipsum dolor sit amet consectetur", "yy": "zug bahn gleis weiche signal turm"}
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(words_of[x].split()) for _ in range(12)), x) for i, x in enumerate(["xx", "yy"] * 30)]
    df = spark.createDataFrame(rows + [(98, None, "xx"), (99, "some text", None)], "doc_id bigint, text string, lang string")
    langs, prob = langid.train(df)
    assert langs == ["xx", "yy"] and np.allclose(prob.sum(0), 1)
    odd = spark.createDataFrame([(1, "lorem dolor"), (2, "gleis turm"), (3, None), (4, "123 ... !!"), (5, "")], "doc_id bigint, text string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(odd, langs, prob).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["xx", "yy", "und", "und", "und"] and got[1][1] > 0.9 and got[3][1] == 0
    assert langid.predict(sample, langs, prob).count() == sample.count()
    assert {x.lang_pred for x in langid.predict(odd, *langid.train(df.limit(0))).collect()} == {"und"}


# quality classifier


def test_quality_learns_from_positives_and_unlabelled(spark, sample):
    r = random.Random(2)
    good = lambda: ". ".join(" ".join(f"{r.choice('abcdefgh')}{r.choice(['an', 'er', 'ing', 'o'])}" for _ in range(9)) for _ in range(6)) + "."
    bad = lambda: " ".join("BUY!!" if r.random() < 0.5 else "$$$" for _ in range(50))
    rows = [(i, good() if i % 5 else bad()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 600, 2)], "doc_id bigint, quality int, toxic int")
    scorer = pu_quality.train(docs, labels, F.col("doc_id") < 500)
    out = {x.doc_id: x.score for x in pu_quality.score(docs, scorer).collect()}
    assert all((out[i] >= 0.7) == (i % 5 > 0) for i in range(500, 600))
    odd = pu_quality.score(sample, scorer)
    assert odd.count() == sample.count() and all(0 <= x.score <= 1 for x in odd.collect())
    none = pu_quality.train(docs.limit(0), labels.limit(0), F.lit(True))
    assert {round(x.score, 6) for x in pu_quality.score(docs, none).limit(3).collect()} == {0.5}


def test_decoding_gives_texts_back(spark):
    texts = ["", " two  spaces ", "plain words", "a \u2581 mark", "\u4f60\u597d \U0001f600", "x" * 500, "line\nbreak", None]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts * 2)], "doc_id bigint, text string, `a.b` string")
    coded = sentencepiece_codec.encode_documents(df).withColumn("text", F.lit("other"))
    back = sentencepiece_codec.decode_documents(coded)
    assert back.columns[:2] == ["doc_id", "a.b"] and "piece_ids" not in back.columns
    assert [r.text for r in back.orderBy("doc_id").collect()] == [t or "" for t in texts * 2]
    vocab = pieces.vocabulary()
    high = next(i for i, b in enumerate(vocab.byte_of) if b == 0xFF)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, -5, 10**9, 0]), (4, [high])], "k int, piece_ids array<int>")
    assert [r.text for r in sentencepiece_codec.decode_documents(odd).orderBy("k").collect()] == ["", "", "", "\ufffd"]
    assert sentencepiece_codec.decode_documents(odd.limit(0)).count() == 0


# pages


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("<html><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>First <b>bold</b>ly&nbsp;said &lt;here&gt;.<p>Second</article><footer>&copy; me</footer></body>", "Head First boldly said <here>. Second"),
        ('<article><p>a<script>if (a < b) { "</p>" }</script>b</p><aside>related</aside><form><input> search</form><p>c</p><div class="comments"><p>I like it</p></div></article>', "ab c"),
        ('<header><h1>Site</h1></header><div id="cookie-banner"><p>We use cookies on this site, as all do, and say so at length here.</p></div><article><header><h1>Kept</h1></header>Text</article>', "Kept Text"),
        ("<article>cut in a tag <p", "cut in a tag"),
        ("<article>before<!-- never closed <p>x</p>", "before"),
        ('<article><p style="display:none">gone</p><p>here</p><ul><li>one<li>two</ul></article>', "here one two"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page, html_text.trained()) == text


LONG_TEXT = "A paragraph of running text that goes on for quite a few words, as text in articles does, and has no link in it at all."


def used(tree):
    return set() if isinstance(tree, int) else {tree[0]} | used(tree[2]) | used(tree[3])


def test_tree_fits_its_table_and_looks_at_both_neighbours():
    tree = html_text.trained()
    assert all(html_text.judged(tree, row[:-1]) == row[-1] for row in html_text.labelled())
    assert {3, 4, 5, 6, 7, 8} <= used(tree)  # words and link shares of the block and of both neighbours
    text = lambda page: html_text.main_text(page, tree)
    # equal blocks, other neighbours
    link = '<p><a href="x">More about this here</a></p>'
    assert "More about" in text(f"<article><p>{LONG_TEXT}</p>{link}<p>{LONG_TEXT}</p></article>")
    assert "More about" not in text(f"<article><p>{LONG_TEXT}</p>{link}{link}{link}</article>")
    assert text(f"<div>Last week</div><p>{LONG_TEXT}</p>") == f"Last week {LONG_TEXT}"
    assert text(f"<p>{LONG_TEXT}</p><div>Last week</div>") == LONG_TEXT


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "main-search", "ad-free", "social-sharing", "layout has-banner"])
def test_a_wrapper_loses_nothing_by_its_name(name):
    for inner in (f"<article><p>{LONG_TEXT}</p></article>", f"<article><h1>Head</h1><p>{LONG_TEXT}</p></article>", f"<main><p>{LONG_TEXT}</p></main>"):
        page = f'<nav><a href="a">Home</a></nav><div class="{name}">{inner}<div class="ad">Buy this now.</div></div><footer>Rights</footer>'
        assert html_text.main_text(page, html_text.trained()) == ("Head " if "h1" in inner else "") + LONG_TEXT


MENU = '<ul><li><a href="a">Home page</a><li><a href="b">All news</a><li><a href="c">Contact</a></ul>'

#: Pages whose blocks are labelled by hand, none of them in the tree's table: the main text, and the page.
PAGES = [
    (f"{LONG_TEXT} He agreed.", f"{MENU}<p>{LONG_TEXT}</p><p>He agreed.</p>"),
    ("Closed today.", "<p>Closed today.</p>"),
    ("Roses are red Violets are blue so it goes", f"{MENU}<p>Roses are red</p><p>Violets are blue</p><p>so it goes</p>{MENU}"),
    (f"{LONG_TEXT} One thing Other thing {LONG_TEXT}", f'<article><p>{LONG_TEXT}</p><ul><li><a href="x">One thing</a><li><a href="y">Other thing</a></ul><p>{LONG_TEXT}</p></article>'),
    (LONG_TEXT, f"<article><p>{LONG_TEXT}</p>{MENU}</article>"),
    (LONG_TEXT, f'<div><p>{LONG_TEXT}</p></div><div class="discussion"><p>{LONG_TEXT} I liked it.</p></div>'),
    (LONG_TEXT, f"<div>We use cookies on this website to improve your visit, and by staying here you agree to that use of them.</div><p>{LONG_TEXT}</p><p>© 2024 Acme</p>"),
    (LONG_TEXT, f"<p>{LONG_TEXT}</p><h3>Related</h3>{MENU}"),
    (LONG_TEXT, f"<div>Acme</div>{MENU}<p>{LONG_TEXT}</p><div>Call us now</div>"),
    ("Bread We baked cookies. Then we ate them.", "<article><h1>Bread</h1><p>We baked cookies.</p><p>Then we ate them.</p></article>"),
    (f"Discussion {LONG_TEXT}", f'<article><section class="discussion"><h2>Discussion</h2><p>{LONG_TEXT}</p></section></article>'),
    ("", MENU),
    (f"Last week {LONG_TEXT}", f"{MENU}<div>Last week</div><p>{LONG_TEXT}</p>"),
    (f"{LONG_TEXT} More about this here {LONG_TEXT}", f'<p>{LONG_TEXT}</p><p><a href="x">More about this here</a></p><p>{LONG_TEXT}</p>'),
    (LONG_TEXT, f"{MENU}<div>Twenty words of an advert that stands between the lines of two menus and wants you to buy this now</div>{MENU}<div>{LONG_TEXT}</div>"),
]


@pytest.mark.parametrize("text,page", PAGES)
def test_pages_labelled_by_hand(text, page):
    assert html_text.main_text(page, html_text.trained()) == text


def test_neighbours_decide_without_an_article():
    """Of blocks outside articles some get another verdict once nothing is known of their neighbours."""
    tree = html_text.trained()
    changed = [of for _, page in PAGES if "<article" not in page for of in html_text.features(page)[1] if html_text.judged(tree, of) != html_text.judged(tree, (*of[:5], 0, 0.0, 0, 0.0))]
    assert len(changed) >= 3


def test_line_breaks_are_spaces():
    verses = "Six short<br>lines with<br/>breaks between<br>them make one<br>block of text<br>all the same, said the poet to the page"
    for page in (f"<div>{verses}</div>", f"<article><p>{verses}</p></article>"):
        assert html_text.main_text(page, html_text.trained()) == re.sub("<br/?>", " ", verses)


def test_long_and_repeated_pages(spark):
    page = "<article>" + "".join(f"<p>Paragraph {i} of a page that goes on and on.</p>" for i in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, page), (1, page), (2, "<article></article>")], "page_id bigint, html string").withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r"))
    out = html_text.extract(df).collect()
    assert sorted(r.text.count("Paragraph") for r in out) == [0, 30_000, 30_000] and out[0]["a.b"] == 1


def test_pages_of_the_table_equal_brute_force(spark):
    """The article of each page by two regular expressions, against the whole query."""
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op7_html_text(spark, "/root/testdata/sf0.001").collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html or "", re.DOTALL)
        text = " ".join(entities.unescape(re.sub(r"<[^>]*>?", " ", re.sub(r"<(script|style).*?</\1>", "", inside[1], flags=re.DOTALL))).split()) if inside else ""
        assert got.pop(r.page_id) == (text, len(text)), r.page_id
    assert not got


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (2, "v", "<article>x é</article>", "old")], "page_id bigint, url string, html string, text string")
    assert rows_of(html_text.extract(df), "page_id", "url", "text", "n_chars") == [(1, "u", "", 0), (2, "v", "x é", 3)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_hidden_is_an_attribute_not_a_word():
    for shown in ('title="The hidden valley"', 'title="a hidden gem"', 'aria-label="Our hidden costs"', "data-x='display:none'", "title='aria-hidden=\"true\"'"):
        assert [b.text for b in html_text.blocks(f"<p {shown}>some text</p>")[0]] == ["some text"], shown
    for unseen in ("hidden", 'class="x" hidden', 'hidden=""', "HIDDEN='until-found'", 'aria-hidden="true"', "aria-hidden = true", 'style="color:red; display : none"', "style=visibility:hidden"):
        assert html_text.blocks(f"<p {unseen}>some text</p>")[0] == [], unseen


# mixing


def test_raking_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(1, 60))), r.choice(["a"] * 6 + ["b", "c"]), r.choice(["x", "x", "y"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    targets = {"source": {"a": 0.4, "b": 0.4, "c": 0.2}, "lang": {"x": 0.5, "y": 0.5}}
    out = mixing.probabilities(mixing.described(df), targets).toPandas()
    cells = out.groupby(["source", "lang", "topic"]).n_tokens.sum().reset_index()
    w = cells.n_tokens.to_numpy(float)
    topic = cells.groupby("topic").n_tokens.sum() ** mixing.TEMPER
    goal = {"source": targets["source"], "lang": targets["lang"], "topic": (topic / topic.sum()).to_dict()}
    for _ in range(60):
        for m, g in goal.items():
            w = w * (cells[m].map(g) / cells.assign(w=w).groupby(m).w.transform("sum")).to_numpy()
    cells["p"] = w / cells.n_tokens / (w / cells.n_tokens).max()
    both = out.merge(cells, on=["source", "lang", "topic"])
    assert (both.p - both.probability).abs().max() < 1e-3
    expected = (out.n_tokens * out.probability).groupby(out.source).sum()
    assert np.allclose(expected / expected.sum(), [0.4, 0.4, 0.2], atol=1e-3)
    drawn = out[out.drawn].groupby("source").n_tokens.sum()
    assert np.allclose(drawn / drawn.sum(), [0.4, 0.4, 0.2], atol=0.08)


def test_mixing_on_odd_rows(spark, sample):
    out = mixing.probabilities(mixing.described(sample))
    rows = out.collect()
    assert len(rows) == sample.count() and all(0 <= r.probability <= 1 for r in rows)
    assert not any(r.drawn for r in rows if not words(r.text)) and {"slot", "row", "score"} <= set(out.columns)
    assert mixing.probabilities(mixing.described(sample.limit(0))).count() == 0


def raked_margins(spark, rows, shares, **options):
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens bigint")
    out = mixing.rake(cells, {m: mixing.targets_for(cells, m, shares.get(m)) for m in mixing.MARGINS}, **options).toPandas()
    return out, {m: out.groupby(m, dropna=False).weight.sum() for m in mixing.MARGINS}


def test_raking_goes_on_until_slow_margins_meet(spark):
    rows = [("a", "x", 0, 10**6), ("a", "y", 0, 30), ("b", "x", 0, 50), (None, "y", 0, 10**6)]
    shares = {"source": {"a": 0.5, "b": 0.2}, "lang": {"x": 0.3}}
    out, sums = raked_margins(spark, rows, shares)
    assert np.allclose(sums["source"][["a", "b"]], [0.5, 0.2], atol=1e-6) and abs(sums["lang"]["x"] - 0.3) < 1e-6
    same, _ = raked_margins(spark, rows, shares, at_once=0, tolerance=1e-4)
    both = out.merge(same, on=["source", "lang", "topic"])
    assert len(both) == 4 and np.allclose(both.weight_x, both.weight_y, atol=1e-3)


def test_raking_tells_of_targets_that_no_weights_meet(spark):
    with pytest.warns(UserWarning, match="no weights meet"):
        raked_margins(spark, [("a", "x", 0, 10), ("b", "y", 0, 10)], {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}})


def test_a_tiny_cell_does_not_throw_away_the_rest(spark):
    rows = [(f"s{i % 4}", "xy"[i % 7 > 4], i % 3, 900 + 13 * i) for i in range(80)] + [("tiny", "x", 0, 5), ("s0", "z", 1, 2)]
    docs = spark.createDataFrame([(i, *r, i * 2654435761) for i, r in enumerate(rows)], "doc_id int, source string, lang string, topic int, n_tokens bigint, draw bigint")
    out = mixing.probabilities(docs, budget=0.6).toPandas()
    expected, total = out.n_tokens * out.probability, out.n_tokens.sum()
    assert abs(expected.sum() / total - 0.6) < 1e-6 and out.probability.between(0, 1).all()
    assert (out[(out.source == "tiny") | (out.lang == "z")].probability == 1).all()
    sums = out.groupby("source").n_tokens.sum()[["s0", "s1", "s2", "s3"]] ** mixing.TEMPER
    got = expected.groupby(out.source).sum()
    assert np.allclose(got[sums.index] / (0.6 * total - 5), sums / sums.sum(), atol=1e-6)
    cells = docs.groupBy(*mixing.MARGINS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")
    ready = mixing.budgeted(cells, {m: mixing.targets_for(cells, m) for m in mixing.MARGINS}, 0.6)
    one, other = (mixing.rake(*ready, tolerance=1e-4, at_once=n).toPandas().set_index(list(mixing.MARGINS)).weight.sort_index() for n in (99, 0))
    assert np.allclose(one, other, rtol=1e-3)
    assert (mixing.probabilities(docs, budget=1.0).toPandas().probability > 1 - 1e-9).all()


def test_distances_from_the_asked_shares_are_told(spark):
    """A tiny source can't give its share: it is drawn whole, and the table tells how far that is from what was asked."""
    rows = [("a", "x", 0, 1000), ("a", "y", 0, 1000), ("b", "x", 0, 900), ("b", "y", 0, 1100), ("tiny", "x", 0, 10)]
    docs = spark.createDataFrame([(i, *r, i) for i, r in enumerate(rows)], "doc_id int, source string, lang string, topic int, n_tokens bigint, draw bigint")
    mixed = mixing.probabilities(docs, targets={"source": {"a": 0.4, "b": 0.4, "tiny": 0.2}}, budget=0.5)
    got = {(r.margin, r.value): (r.asked, r.expected) for r in mixing.deviations(mixed, {"source": {"a": 0.4, "b": 0.4, "tiny": 0.2}}).collect()}
    size, drawn = 4010, mixed.selectExpr("sum(n_tokens * probability)").first()[0]
    assert abs(drawn - size / 2) < 1e-3
    assert np.allclose(got["source", "tiny"], (0.2, 10 / drawn)) and np.allclose(got["source", "a"], (0.4, (drawn - 10) / 2 / drawn), atol=1e-5)
    assert abs(sum(e for (m, _), (_, e) in got.items() if m == "lang") - 1) < 1e-9
    assert mixing.deviations(mixed.limit(0)).count() == 0


def brute_measures(text):
    """The measurements in plain Python."""
    raw, n = text.encode(), len(text.encode())
    spans = [(m.start(), m.group()) for m in re.finditer(rb"[^ \t\n\v\f\r]+", raw)]
    tokens = [w for _, w in spans]
    m, per = len(tokens), max(1, len(tokens))
    log = lambda x: math.log1p(30 * x)
    kind = lambda byte: next((k for k, chars in pu_quality.CLASSES.items() if byte in chars), None)
    out = [math.log1p(n) / 10] + [log(sum(kind(b) == k for b in raw) / max(1, n)) for k in pu_quality.CLASSES]
    grams = [tuple(tokens[i : i + 3]) for i in range(max(1, m - 2))] if m else []
    out += [math.log1p(m) / 8, sum(map(len, tokens)) / per / 10, sum(len(w) <= 2 for w in tokens) / per, sum(len(w) >= 14 for w in tokens) / per]
    out += [log(sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / per), len(set(tokens)) / per, len(set(grams)) / max(1, len(grams))]
    ends = [kind(w[-1]) for w in tokens]
    out += [log(sum(kind(w[0]) == "upper" for w in tokens) / per), log(ends.count("symbol") / per), log(ends.count("mark") / per)]
    return out + [log((ends.count("stop") + ends.count("comma")) / per), log(sum(w[:1] in b"|" and len(w) == 1 for w in tokens) / per)]


def test_measurements_equal_plain_python():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["Ab ", "the ", "| ", "x!? ", "12, ", "é日", "\n", "aa. ", "averylongwordindeed "]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", " ", "word"]
    raw = [t.encode() for t in texts]
    at = np.r_[0, np.cumsum([len(r) for r in raw])]
    got = pu_quality.measure(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])
    assert np.allclose(got, [brute_measures(t) for t in texts])


@pytest.mark.parametrize("negative", [False, True])
def test_a_step_follows_the_non_negative_risk(monkeypatch, negative):
    """The first step of a fit, against finite differences of the risk: down the whole risk, or, where the part of the unseen negatives is below
    0, up that part. The rate is so small and the moments so fresh that a step is the sign of the gradient."""
    rng = np.random.default_rng(3)
    p, u, prior = rng.normal(1.0, 1.0, (40, 5)), rng.normal(0.0, 1.0, (60, 5)), 0.98 if negative else 0.6
    monkeypatch.setattr(pu_quality, "STEPS", 1)
    monkeypatch.setattr(pu_quality, "DECAY", 0.0)
    start = pu_quality.Scorer(5, 7)
    start.mean, start.scale = u.mean(0), u.std(0)
    if negative:  # the scorer as it starts finds the positives good and the unlabelled bad: less than nothing is left for the negatives
        side = np.sign(start.raw(np.full((1, 5), 4.0))[0][0])
        p, u = p * 0.01 + 9.0 * side, u * 1.0
        start.mean, start.scale = u.mean(0), np.maximum(u.std(0), 1e-3)
    fitted = pu_quality.fit(p, u, prior, 7)
    draw = np.random.default_rng(7)
    xp, xu = start.scaled(p)[draw.integers(0, len(p), pu_quality.BATCH)], start.scaled(u)[draw.integers(0, len(u), pu_quality.BATCH)]

    def risks():
        zp, zu = start.raw(xp)[0], start.raw(xu)[0]
        return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

    unseen = risks()[1]
    assert (unseen < 0) == negative
    objective = (lambda: sum(risks())) if unseen >= 0 else (lambda: -risks()[1])
    for i in range(4):
        for k in np.ndindex(start.w[i].shape):
            before = start.w[i][k]
            start.w[i][k] = before + 1e-5
            above = objective()
            start.w[i][k] = before - 1e-5
            slope = (above - objective()) / 2e-5
            start.w[i][k] = before
            if abs(slope) > 1e-5:
                assert np.sign(before - fitted.w[i][k]) == np.sign(slope), (i, k)


def test_arrow_helpers():
    from meterlake.llm.fingerprints64 import received, sent, text_parts

    data, at = text_parts(pa.array(["ab", None, "é"]).slice(1))
    assert bytes(data[at[0] : at[-1]]).decode() == "é" and np.diff(at).tolist() == [0, 2]
    kind = np.dtype([("a", "<u8"), ("b", "u1")])
    rec = np.array([(i, i % 7) for i in range(50)], kind)
    batch = sent(rec["a"].astype(np.int64) % 3, rec)
    assert sorted(received(batch.column(1), kind).tolist()) == sorted(rec.tolist())
