"""Near duplicates against all pairs on small tables; word hashes against plain splitting."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import neardup
from tidewell.llm.words import CHUNK, WordHasher


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_word_hashes():
    rng = random.Random(2)
    texts = ["", None, "A", " \t", "É é", "x" * 700] + ["".join(rng.choice(["ab", "C", " ", "\n", "é", "\x85"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    seen: dict = {}
    array = pa.array(["skipped", *texts]).slice(1)
    for first, hashes, bounds in WordHasher().column(array):
        for i in range(len(bounds) - 1):
            own = hashes[bounds[i]:bounds[i + 1]].tolist()
            words = split(texts[first + i])
            assert len(own) == len(words)
            for w, h in zip(words, own):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_text_hashes():
    words = [f"w{i % 977}" for i in range(CHUNK // 3)]
    hasher = WordHasher()
    (_, whole, _), = hasher.column(pa.array([" ".join(words)]))
    (_, some, _), = hasher.column(pa.array([" ".join(words[:977])]))
    assert np.array_equal(whole, np.resize(some, len(words)))


def brute(texts, words, percent=80):
    sets = []
    for t in texts:
        w = split(t)
        k = min(words, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_groups(docs, words):
    rng = random.Random(words)
    base = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    texts = ["", None, " ", "one", "ONE", "one two", "Two one", "a b c d e f"]
    for _ in range(6):
        body = base(120)
        texts += [" ".join(edited(rng, body, rng.choice([0, 1, 2, 5, 9]))) for _ in range(12)]
    chain = base(90)  # neighbours are close, ends are not
    for step in range(14):
        chain = edited(rng, chain, 3 if words == 2 else 1)
        texts.append(" ".join(chain))
    texts += texts[8:14]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    got = neardup.near_duplicates(docs(texts), words=words).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == brute(texts, words)


def test_one_bucket(docs, monkeypatch):
    """One common bucket for everything: only the exact join of open buckets can find the groups."""
    rng = random.Random(8)
    texts = []
    for _ in range(5):
        body = [f"v{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(edited(rng, body, 1)) for _ in range(6)]
    rng.shuffle(texts)
    true = neardup.signatures

    def one_bucket(*args):
        from pyspark.sql import functions as F

        return true(*args).withColumn("bands", F.array(F.lit(7).cast("long")))

    monkeypatch.setattr(neardup, "signatures", one_bucket)
    got = neardup.near_duplicates(docs(texts), words=2).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == brute(texts, 2)


def test_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (7, "A b c d"), (None, "a b c d"), (7, "x y z w"), (9, "x y z w"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (None, None, True), (None, None, True)], key=str)
    kept = sorted([(r.doc_id, r.text) for r in neardup.keep_one(docs).collect()], key=str)
    assert kept == [(5, "a b c d"), (None, ""), (None, "a b c d")]
    assert neardup.near_duplicates(docs.where("false")).count() == neardup.keep_one(docs.where("false")).count() == 0


def test_pruning_bounds():
    """Simulated pairs at the threshold are hardly ever pruned."""
    need = neardup.least_matches()
    assert need == sorted(need) and need[-1] < 0.8 * neardup.CHECKED
    matches = np.random.default_rng(1).binomial(neardup.BATCH, 0.8, (200_000, len(need))).cumsum(axis=1)
    assert (matches < need).any(axis=1).mean() < 1e-4
