"""Search against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.operators import search, skew
from tidewell.plans import support, views


def test_keyword_search_equals_brute_force(spark):
    import re

    rnd = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"] + ["the", "and", "with"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 4))), " ".join(rnd.choices(words, k=rnd.randrange(0, 60))))
            for i in range(150)]
    asks = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 12)))) for i in range(60)]

    def bag(t):
        return set(re.findall("[a-z]{3,}", t.lower())) - set(fixed.STOP_WORDS)

    want = []
    for q, message in asks:
        scores = [(len(bag(message) & bag(t)) * 3 + len(bag(message) & bag(b)) / max(len(bag(b)), 1) * 10, d) for d, t, b in docs]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:3] if bag(message) else []
        want += [(q, d, r + 1, round(s, 6)) for r, (s, d) in enumerate(best) if s >= 1.5]
    got = search.keyword_search(
        spark.createDataFrame(asks, "query_id bigint, message string"),
        spark.createDataFrame(docs, "doc_id bigint, title string, text string"))
    got = [(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in got.collect()]
    assert sorted(got) == sorted(want)


def test_keyword_search_in_small_blocks_joins_no_pairs(spark):
    docs = [(i, f"alpha title{i % 3}", " ".join(["alpha", *(f"word{'abcdefgh'[(i + j) % 8]}" for j in range(i % 7))])) for i in range(90)]
    asks = [(i, " ".join(["alpha", *(f"word{'abcdefgh'[(i * 3 + j) % 8]}" for j in range(i % 5))])) for i in range(70)]
    queries = spark.createDataFrame(asks, "query_id bigint, message string")
    documents = spark.createDataFrame(docs, "doc_id bigint, title string, text string")
    found = [search.keyword_search(queries, documents, **sizes) for sizes in ({"query_rows": 9, "document_rows": 20}, {})]
    few, one = (sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in f.collect()) for f in found)
    assert few == one and len(one) == 3 * len(asks)
    want = []
    for q, message in asks:
        words = set(message.split())
        words = {w for w in words if len(w) > 2}
        scores = [(-(3 * len(words & {"alpha", "title"}) + len(words & set(b.split())) / len(set(b.split())) * 10), d) for d, _, b in docs]
        want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:3])]
    assert one == sorted(want)
    # every message shares a word with every document; what is joined are the best rows with their titles only
    plan = found[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_keyword_search_copies_neither_side(spark, monkeypatch):
    """Queries and vocabulary in rounds, documents in blocks: the same rows, and no side is copied for the blocks of the other."""
    import re

    rnd = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnr"]
    docs = [(i, " ".join(rnd.choices(words[:30], k=rnd.randrange(0, 7))), " ".join(rnd.choices(words, k=rnd.choice([1, 3, 9, 60, 200]))))
            for i in rnd.sample(range(10**9), 400)]
    docs += [(i + 10**9, t, b) for i, t, b in docs[:80]]  # equal scores go by doc_id
    docs += [(2 * 10**9, " ".join(words), "all"), (2 * 10**9 + 1, None, None)]  # 120 title words, 360 points
    asks = [(f"q{i}", " ".join(rnd.choices(words, k=rnd.randrange(0, 30)))) for i in range(80)] + [("all", " ".join(words)), ("none", None)]

    def bag(t):
        return set(re.findall("[a-z]{3,}", (t or "").lower())) - set(fixed.STOP_WORDS)

    bags = [(d, bag(t), bag(b)) for d, t, b in docs]
    want = []
    for q, message in asks:
        scores = sorted((-(len(bag(message) & t) * 3 + len(bag(message) & b) / max(len(b), 1) * 10), d) for d, t, b in bags)[:3]
        want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(scores) if s <= -1.5]
    queries = spark.createDataFrame(asks, "query_id string, message string")
    documents = spark.createDataFrame(docs, "doc_id bigint, title string, text string")
    for limit in (None, "QUERY_WORDS", "VOCABULARY", "BLOCK_WORDS"):
        with monkeypatch.context() as m:
            if limit:
                m.setattr(search, limit, 100 if limit != "QUERY_WORDS" else 400)
            found = search.keyword_search(queries, documents, **({} if limit else {"query_rows": 30, "document_rows": 25}))
            assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()) == sorted(want), limit
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "CoGroup" not in plan and "sequence(0" not in plan


def test_only_wanted_rows_are_shuffled(spark, monkeypatch):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("body"))
    wanted = spark.createDataFrame([(5,), (5,), (7,), (500,), (None,)], "doc_id bigint")
    found = skew.only_wanted(rows, wanted, "doc_id")
    assert sorted(r.doc_id for r in found.collect()) == [5, 7]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 2)
    assert skew.only_wanted(rows, wanted, "doc_id").count() == 100


def test_audit_log_shuffles_no_unasked_text(spark):
    """The texts of the knowledge base meet the hits where they are read."""
    handled = support._handled(spark, "/root/testdata/sf0.001")
    plan = handled._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (" in plan and "strategy=broadcast" in plan


def test_vector_search_in_small_blocks(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(120, 8))
    rows = [("big" if i % 4 else "small", i, [float(x) for x in base[i]]) for i in range(120)]
    corpus = spark.createDataFrame(rows, "tenant string, doc_id bigint, vector array<double>")
    queries = corpus.withColumnRenamed("doc_id", "query_id").where(F.col("query_id") < 40)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = []
    for q in range(40):
        mine = [d for d in range(120) if rows[d][0] == rows[q][0]]
        scored = sorted(((-float(unit[q] @ unit[d]), d) for d in mine if unit[q] @ unit[d] > 0.4))[:5]
        want += [(q, d, r + 1) for r, (_, d) in enumerate(scored)]
    for block in (7, 1000):
        got = search.vector_search(queries, corpus, 5, 0.4, block_rows=block).collect()
        assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got) == sorted(want)


def test_vector_block_holds_few_scores():
    """Scores are held for some queries at a time; equal scores go by doc_id, also where they end the list."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(1)
    base = rng.normal(size=(500, 8))
    corpus = pd.DataFrame({"doc_id": rng.permutation(4000), "vector": [base[i % 500] for i in range(4000)]})  # eight of each
    queries = pd.DataFrame({"query_id": range(1500), "vector": [base[i % 500] for i in range(1500)]})
    tracemalloc.start()
    found = search._best_in_block(5, 0.4)(queries, corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores at once are 48 MB, and their order as much again
    same = corpus.groupby(corpus.index % 500)["doc_id"].apply(lambda x: sorted(x)[:5])
    got = found.groupby("query_id")["doc_id"].apply(list)
    assert all(got[q] == same[q % 500] for q in range(1500)) and len(found) == 7500


def test_vector_block_is_exact_beside_rough_scores():
    """Against all pairs: near ties, equal vectors anywhere, vectors without a direction or a number, fewer vectors than k."""
    import pandas as pd

    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 16))
    base[::7] = base[3] + rng.normal(size=(100, 16)) * 1e-7  # single precision cannot tell these apart
    base[5::50] = base[11]
    base[20], base[21] = 0, np.nan
    for n in (3, 150, 700):
        for least in (0.4, 0.9, 0.99999):
            ids = rng.permutation(10_000)[:n]
            found = search._best_in_block(5, least)(
                pd.DataFrame({"query_id": range(300), "vector": list(base[:300])}), pd.DataFrame({"doc_id": ids, "vector": list(base[:n])}))
            size = np.sqrt((base * base).sum(axis=1, keepdims=True))
            unit = base / np.where(size == 0, 1, size)
            want = []
            for q in range(300):
                scores = (unit[q] * unit[:n]).sum(axis=1)
                best = sorted((-s, d) for s, d in zip(scores, ids) if s > least)[:5]
                want += [(q, d, -s) for s, d in best]
            assert list(zip(found["query_id"], found["doc_id"], found["score"])) == want


def test_sources_distinct_cut_and_budget(spark):
    rows = [(1, 0, "Your notes", "n" * 9000), (1, 1, "A", "a" * 2000), (1, 2, "a", "A" * 2000), (1, 3, " ", "b" * 1800),
            (1, 4, "C", "   "), (1, 5, "D", "d" * 3000), (1, 6, "E", "e"), (2, 0, "X", "x")]
    df = spark.createDataFrame(rows, "topic_id int, rank int, title string, text string")
    out = search.gather_sources(df, 1800, 8000, 11000).orderBy("topic_id", "rank").collect()
    # D would go over the budget, and nothing after it is admitted
    assert [(r["topic_id"], r["title"], len(r["text"])) for r in out] == [
        (1, "Your notes", 8000), (1, "A", 1800), (2, "X", 1)]


def test_upsert_and_fallback(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, v int, t string")
    assert sorted(tuple(r) for r in search.latest(df, "id", "v").collect()) == [("a", 2, "y"), ("b", 1, "z")]
    first = df.where("id = 'a' and v = 1")
    assert search.fallback(first, df.where("v = 1"), "id").count() == 2


def test_embedding_hook(spark):
    model = search.embedder(lambda texts: [[float(len(t)), 1.0] for t in texts])
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    assert [r[0] for r in df.select(model(F.col("t"))).collect()] == [[2.0, 1.0], [1.0, 1.0]]
    norm = [sum(x * x for x in r[0]) for r in df.select(search.hash_embedding(F.col("t"))).collect()]
    assert norm == [1.0, 1.0]


def test_a_word_is_hashed_once_per_batch(spark, monkeypatch):
    monkeypatch.setattr(search, "embedder", lambda function: lambda column: function)
    embed, calls, md5 = search.hash_embedding(F.col("t")), [], search.hashlib.md5
    monkeypatch.setattr(search.hashlib, "md5", lambda b: calls.append(b) or md5(b))
    vectors = embed(["one two two", "two one"] * 50 + [""])
    assert sorted(calls) == [b"one", b"two"] and len(vectors) == 101 and not vectors[-1].any()


def test_titles_are_the_first_six_words(spark, monkeypatch):
    texts = [None, "", " ", "a", " a\tb ", "a b  c\nd e f", "a b c d e f ", " a b c d e f g", "x" * 2_000_000 + " y"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    monkeypatch.setattr(views, "documents", lambda *_: docs)
    got = {r.doc_id: r.title for r in views.kb(spark, "").collect()}
    import re
    assert [got[i] for i in range(len(texts))] == [t if t is None else " ".join(re.sub(r"\s+", " ", t).split(" ")[:6]) for t in texts]
