"""Suffix tree, nearest neighbours and resampling against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_neardup import split
from tidewell.llm import nearest, resample, suffix_tree


class SlowTree:
    """The same tree with dictionaries of word tuples."""

    def __init__(self, texts):
        s = suffix_tree
        self.count = Counter(w for t in texts for w in [*split(t), None])
        self.n = sum(self.count.values())
        self.frequent = {w for w, c in self.count.items() if w is not None and c >= s.SYMBOL * self.n}
        symbol = Counter()
        for w, c in self.count.items():
            symbol[self.symbol(w)] += c
        size = 2 + len(self.frequent)
        self.first = defaultdict(lambda: 0.5 / (self.n + 0.5 * size), {k: (c + 0.5) / (self.n + 0.5 * size) for k, c in symbol.items()})
        self.rare_total = symbol["<rare>"]
        self.rare_distinct = len(self.count) - (None in self.count) - len(self.frequent)
        self.kept, self.next, self.total = set(), {}, {}
        candidates = {(w,) for w in self.frequent}
        self.in_head = set()
        for depth in range(1, s.DEPTH + 1):
            found = defaultdict(Counter)
            for t in texts:
                w = [self.symbol(x) for x in [*split(t), None]]
                for i in range(depth, len(w)):
                    if tuple(w[i - depth:i]) in candidates:
                        found[tuple(w[i - depth:i])][w[i]] += 1
            longer, kept = set(), set()
            self.in_head |= candidates
            for context, after in found.items():
                self.total[context] = sum(after.values())
                self.next[context] = {k: c for k, c in after.items() if c >= s.ENTRY * self.n}
            for context in found:
                divergence, p_rest, q_rest = 0.0, 1.0, 1.0
                for k, c in self.next[context].items():
                    p, q = c / self.total[context], self.chance(context[1:], k)
                    divergence, p_rest, q_rest = divergence + p * math.log(p / q), p_rest - p, q_rest - q
                    if c >= s.SYMBOL * self.n and k in self.frequent:
                        longer.add((*context, k))
                if p_rest > 1e-12:
                    divergence += p_rest * math.log(p_rest / max(q_rest, 1e-12))
                if divergence >= s.DIVERGENCE and self.next[context]:
                    kept.add(context)
            self.kept |= {c[i:] for c in kept for i in range(len(c))}
            candidates = longer
        self.grow_tail(texts)

    def grow_tail(self, texts):
        s = suffix_tree
        self.numbered = {w for w, c in self.count.items() if w is not None and c >= s.HEAD * self.n}
        self.tail, self.after = set(), defaultdict(Counter)
        for t in texts:
            words = [*split(t), None]
            for i, w in enumerate(words):
                for context in self.contexts(words, i):
                    if context not in self.in_head:
                        self.after[context][self.word(w)] += 1
        for context in sorted(self.after, key=len):
            after, total = self.after[context], sum(self.after[context].values())
            left_out = {w: (c - 1) / self.word_chance(context[1:], w) + s.PRIOR for w, c in after.items()}
            gain = sum(c * math.log(left_out[w] / (total - 1 + s.PRIOR)) for w, c in after.items())
            if total >= s.LEAST and gain >= s.GAIN:
                self.tail.add(context)
        self.tail |= {c[i:] for c in self.tail for i in range(len(c)) if c[i:] not in self.in_head}

    def contexts(self, words, i):
        """Contexts of numbered words that end before word i, shortest first."""
        for d in range(1, suffix_tree.DEPTH + 1):
            if d > i or words[i - d] not in self.numbered:
                return
            yield tuple(words[i - d:i])

    def word(self, w):
        return w if w is None or w in self.numbered else "<other>"

    def share(self, w):
        scale = self.rare_total + 0.5 * (self.rare_distinct + 1)
        mine = [x for x in self.numbered if x not in self.frequent]
        if w == "<other>":
            return 1 - sum((self.count[x] + 0.5) / scale for x in mine)
        return (self.count[w] + 0.5) / scale if w in mine else 1.0

    def word_chance(self, context, w):
        """Chance of a word of the head, the end or the class of the other words in its longest suffix state."""
        symbol = "<rare>" if w == "<other>" else self.symbol(w)
        p = self.chance(context, symbol) * self.share(w)
        for i in range(len(context) - 1, -1, -1):
            if context[i:] in self.tail:
                after = self.after[context[i:]]
                p = (after.get(w, 0) + suffix_tree.PRIOR * p) / (sum(after.values()) + suffix_tree.PRIOR)
        return p

    def symbol(self, w):
        return "<end>" if w is None else w if w in self.frequent else "<rare>"

    def chance(self, context, k):
        p = self.first[k]
        for i in range(len(context) - 1, -1, -1):
            c = context[i:]
            if c in self.kept:
                after = self.next[c]
                rest = self.total[c] - sum(after.values())
                p = (after.get(k, 0) + (suffix_tree.PRIOR + rest) * p) / (self.total[c] + suffix_tree.PRIOR)
        return p

    def score(self, text):
        words, total = [*split(text), None], 0.0
        scale = self.rare_total + 0.5 * (self.rare_distinct + 1)
        for i, k in enumerate(words):
            context, w = max(self.contexts(words, i), key=len, default=()), self.word(k)
            total += math.log10(self.word_chance(context, w))
            if w == "<other>":
                total += math.log10((self.count[k] + 0.5) / scale / self.share(w))
        return total

    def base(self, text):
        return sum(math.log10((self.count[w] + 0.5) / (self.n + 0.5 * (len(self.count) + 1))) for w in [*split(text), None])


def chain(seed, count):
    """Texts of a second-order chain over few words, with rare words between."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        a, b, words = 0, 1, []
        for _ in range(rng.randint(0, 60)):
            a, b = b, (2 * a + b + (rng.random() < 0.2) * rng.randint(0, 7)) % 8
            words.append(f"R{rng.randint(0, 400)}" if rng.random() < 0.15 else f"w{b}")
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("limits", [(1e-6, 2e-4, 2e-6, 2_000_000), (0.004, 0.02, 0.004, 700), (1e-3, 0.05, 1e-3, 700), (1e-6, 2.0, 1e-6, 100)])
def test_suffix_tree(docs, monkeypatch, limits):
    monkeypatch.setattr(suffix_tree, "HELD_TOKENS", 300)
    for name, value in zip(("HEAD", "SYMBOL", "ENTRY", "SHARD"), limits):
        monkeypatch.setattr(suffix_tree, name, value)
    texts = ["", None, "  ", "unseen words Only"] + chain(4, 250) + ["w1 w2 w1"] * 2
    got = suffix_tree.score(docs(texts)).orderBy("doc_id").collect()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    slow = SlowTree([t for t, h in zip(texts, held) if not h])
    if limits[1] < 0.05:
        assert len(slow.kept) > 8 and max(map(len, slow.kept)) >= 2
    if limits[1] > 0.01:
        assert len(slow.tail) > 20 and 3 in set(map(len, slow.tail))
    for r, text, h in zip(got, texts, held):
        words = [*split(text), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(words), sum(w in slow.count for w in words), slow.n)
        assert math.isclose(r.base_score, slow.base(text), rel_tol=1e-9)
        assert math.isclose(r.score, slow.score(text), rel_tol=1e-6), text
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.05 * sum(r.n_tokens for r in out)


def test_distributions_sum_to_one(docs):
    slow = SlowTree(chain(5, 100))
    symbols = [*slow.frequent, "<rare>", "<end>"]
    assert all(math.isclose(sum(slow.chance(c, k) for k in symbols), 1) for c in slow.kept)
    words = [*slow.numbered, "<other>", None]
    assert all(math.isclose(sum(slow.word_chance(c, w) for w in words), 1) for c in slow.tail)


def test_tail_of_the_tree_grows_with_the_corpus(docs, monkeypatch):
    """Held-out texts gain more per token over single words when there is more to learn from; a text seen twice scores apart from its words."""
    monkeypatch.setattr(suffix_tree, "SYMBOL", 0.2)  # all but a few contexts are in the tail
    rng, texts = random.Random(3), []
    for _ in range(600):
        a, b, words = 0, 1, []
        for _ in range(40):
            a, b = b, (7 * a + 11 * b + 3) % 40 if rng.random() < 0.9 else rng.randrange(40)
            words.append(f"v{b}")
        texts.append(" ".join(words))
    few, many = suffix_tree.score(docs(texts[:75])).collect(), suffix_tree.score(docs(texts)).where("doc_id < 75").collect()
    per_token = [sum(r.score - r.base_score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out) for rows in (few, many)]
    assert per_token[1] > per_token[0] + 0.01
    words = [f"u{rng.randrange(3000)}" for _ in range(9000)]
    plain = [" ".join(words[i:i + 30]) for i in range(0, 9000, 30)]
    trains = [i for i in range(310) if zlib.crc32(str(i).encode()) % 5 != 1]
    one, other = trains[5], next(i for i in trains if i >= 300)
    rows = suffix_tree.score(docs([*plain, *[""] * (other - 300), plain[one]])).where("not held_out and n_tokens > 1").collect()
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in rows}
    twice = [gain.pop(i) for i in (one, other)]
    assert min(twice) > max(gain.values()) + 0.3


def test_suffix_tree_edges(spark, docs):
    nothing = docs(["x"]).where("false")
    assert suffix_tree.score(nothing).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    row = suffix_tree.score(only).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None)], "doc_id long, text string")
    rows = suffix_tree.score(twice).collect()
    assert len(rows) == 3 and rows[0].train_tokens == 6


def exact(vectors, ids, query, k=10):
    gap = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
    gap[query] = np.inf
    order = np.lexsort((ids, gap))[:k]
    return [(int(ids[i]), gap[i]) for i in order]


def test_nearest(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 24))
    vectors = (centres[rng.integers(0, 12, 3000)] + 0.7 * rng.standard_normal((3000, 24))).astype(np.float32)
    vectors[500:900] = vectors[500]  # one vector many times
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = nearest.search(table, every=50, block=700, group=25).collect()
    lists = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        lists[r.query_id].append((r.vec_id, r.score))
    assert sorted(lists) == list(range(0, 3000, 50)) and all(len(v) == 10 for v in lists.values())
    hits, wide = 0, vectors.astype(np.float64)
    for query, found in lists.items():
        hits += len({v for v, _ in found} & {v for v, _ in exact(wide, np.arange(3000), query)})
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        assert all(math.isclose(s, math.dist(wide[v], wide[query]), rel_tol=1e-12) for v, s in found)
    assert hits / (10 * len(lists)) >= 0.97
    assert [v for v, _ in lists[500]] == list(range(501, 511))


def test_few_vectors_are_verified_on_vectors_without_clusters():
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((4_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    index, asked = nearest.Index(vectors), np.arange(0, 4_000, 100)
    found = index.search(vectors[asked], asked, 10)
    hits = sum(len(set(places.tolist()) & {v for v, _ in exact(vectors, np.arange(4_000), q)}) for q, (places, _) in zip(asked, found))
    assert hits / 400 >= 0.9
    assert index.verified <= len(asked) * (10 + nearest.SHARE * 4_000 + 1)


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, []), (100, [2.0]), (None, [1.0, 1.0]), (8, [0.0, 3.0]), (200, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest.search(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 200, 0.0), (0, 3, 8, math.sqrt(10)), (200, 1, 0, 0.0), (200, 2, 1, 0.0), (200, 3, 8, math.sqrt(10))]
    assert nearest.search(table.where("false")).count() == 0


def quality_rows(count=900):
    rng = random.Random(12)
    texts, good = [], []
    for _ in range(count):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 80))]
        good.append(rng.random() < 0.8)
        texts.append(" ".join(words) if good[-1] else "!! ".join(w.upper() for w in words))
    return texts, good


def test_log_ratio(spark, docs):
    """Bucket counts against a loop over tokens."""
    texts = ["a b, C", None, "", "!!a", "b b"]
    labels = spark.createDataFrame([(0, 1), (3, 0), (9, 1)], "doc_id long, quality int")
    ratio = resample.log_ratio(docs(texts), labels)
    tokens = [["a", "b", ",", "c"], [], [], ["!!", "a"], ["b", "b"]]
    hasher = resample.WordHasher(signs=True)
    code = lambda w: hasher.hash(np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64))[0]
    counts = np.zeros((2, resample.BUCKETS))
    for i, words in enumerate(tokens):
        buckets = [int(code(w)[0]) % resample.BUCKETS for w in words]
        for a, b in zip(words, words[1:]):
            buckets.append(int(resample.mix(code(a) * np.uint64(3) ^ code(b))[0]) % resample.BUCKETS)
        for b in buckets:
            counts[0, b] += 1
            counts[1, b] += i == 0
    chance = (counts + 1) / (counts.sum(axis=1, keepdims=True) + resample.BUCKETS)
    assert np.allclose(ratio, np.log(chance[1]) - np.log(chance[0]))
    weights = {r.doc_id: r.log_ratio for r in resample.weigh(docs(texts), labels).collect()}
    assert weights[1] == weights[2] == 0 and not math.isclose(weights[0], 0)


def test_resampling(spark, docs):
    texts, good = quality_rows()
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i % 3 == 0], "doc_id long, quality int")
    rows = resample.resample(docs(texts), labels).collect()
    share = sum(good[::3]) / len(good[::3])
    kept = {r.doc_id for r in rows if r.kept}
    assert len(rows) == len(texts) and abs(len(kept) - share * len(texts)) <= 1
    least = min(r.sample_key for r in rows if r.kept)
    assert all(r.kept == (r.sample_key >= least) for r in rows)
    right = [g for i, g in enumerate(good) if i in kept]
    assert sum(right) / len(right) > 0.95
    assert len([r for r in resample.resample(docs(texts), labels, share=0.1).collect() if r.kept]) == 90


def test_gumbel(spark):
    """Without weights the sample is uniform: keys have the Gumbel mean."""
    from pyspark.sql import functions as F

    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    keys = [r.sample_key for r in resample.resample(table, labels, share=0.5).collect()]
    assert abs(np.mean(keys) - 0.5772) < 0.03 and abs(np.var(keys) - math.pi**2 / 6) < 0.1
    assert resample.resample(table.where("false"), labels).count() == 0


def test_target_model_counts_all_good_texts(spark):
    table = spark.range(20_200).selectExpr("id as doc_id", "concat('w', id, ' v', id % 7) as text")
    labels = table.selectExpr("doc_id", "1 as quality")
    assert np.abs(resample.log_ratio(table, labels)).max() == 0
    with_missing = table.unionAll(table.limit(1).selectExpr("cast(null as long)", "'only here'"))
    ratio = resample.log_ratio(with_missing, labels)
    assert ratio.min() < 0 and (ratio != 0).all()


@pytest.mark.parametrize("most_bytes", [1 << 20, 8])
def test_target_texts_are_exact_whatever_the_filter_lets_pass(spark, most_bytes):
    table = spark.range(3_000).selectExpr("id as doc_id", "concat('t', id) as text").union(
        spark.createDataFrame([(None, "none"), (7, None), (9, "t9")], "doc_id long, text string"))
    good = spark.createDataFrame([(i,) for i in [*range(0, 3_000, 7), 9, -4, 99_999]], "_id long")
    got = [r.text for r in resample.target_texts(table, good, "doc_id", "text", most_bytes).collect()]
    assert sorted(got) == sorted([f"t{i}" for i in [*range(0, 3_000, 7), 9, 9]])


def test_kept_rows_against_a_sort(spark, docs):
    """The rows kept are those with the largest log weight plus Gumbel number of their id."""
    import hashlib

    texts, good = quality_rows(400)
    texts += [None, "", texts[0], texts[0]]
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i % 2] + [(None, 1), (5_000, 0)], "doc_id long, quality int")
    weights = {r.doc_id: r.log_ratio for r in resample.weigh(docs(texts), labels).collect()}
    keys = {}
    for i in range(len(texts)):
        u = int(hashlib.md5(f"{resample.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52 + 2.0**-53
        keys[i] = weights[i] - math.log(-math.log(u))
    share = (sum(good[1::2]) + 1) / (len(good[1::2]) + 2)
    best = sorted(keys, key=keys.get, reverse=True)[:round(share * len(texts))]
    rows = resample.resample(docs(texts), labels).collect()
    assert {r.doc_id for r in rows if r.kept} == set(best)
    assert all(math.isclose(r.sample_key, keys[r.doc_id], rel_tol=1e-9, abs_tol=1e-9) for r in rows)


def test_without_good_labels_the_caller_chooses(spark, docs):
    bad = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, quality int")
    texts = [f"text {i}" for i in range(10)]
    assert sum(r.kept for r in resample.resample(docs(texts), bad).collect()) == 10
    assert sum(r.kept for r in resample.resample(docs(texts), bad, without_target=0.3).collect()) == 3
