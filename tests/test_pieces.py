"""Texts in pieces, code over several lines, and the inverted file of the vector search."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import lint, packing, search, sequences
from tidewell.plans import texts

WHOLE = re.compile(r"(?s)<think>.*?(</think>|\Z)")
TEXTS = [
    "Hello <think>secret reasoning</think> world!", "List<String> a < b", "<<think>x</think>y", "a <thin", "<think>never ends </thin",
    "a</think>b<think></think>c<think>d", "<th<think>q</th</think>r", "", "<think", "x<think>1</think><think>2</think>< think>",
]


def run(pieces):
    rule = packing.think_rule("n", "piece")
    frame = sequences.pd.DataFrame({"n": range(len(pieces)), "piece": pieces})
    state, out, rest = None, "", ""
    for start in range(0, len(frame), 2):  # the state is carried from batch to batch
        new, state = rule.run(state, frame.iloc[start:start + 2])
        out += "".join(new["kept"])
        rest = new["rest"][-1]
    return out + rest


@pytest.mark.parametrize("text", TEXTS)
def test_tags_cut_at_every_place(text):
    want = WHOLE.sub("", text)
    for size in range(1, len(text) + 2):
        assert run([text[i:i + size] for i in range(0, len(text), size)] or [text]) == want, size
    for i in range(len(text)):
        assert run([text[:i], "", text[i:]]) == want


def test_pieces_of_one_long_text(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["<think>", "</think>", "<", "th", "plain words ", "<thi"]) for _ in range(3_000))
    rows = [(k, i, t[i * 3:i * 3 + 3]) for k, t in (("long", text), (None, "a<think>b")) for i in range(-(-len(t) // 3))]
    df = spark.createDataFrame(rows, "k string, n int, piece string")
    work = sequences.Work()
    kept = sequences.sequential(df, ["k"], packing.think_rule("n", "piece"), 1_500, work)
    got = {r["k"]: r["text"] for r in packing.joined(kept, ["k"], "n").collect()}
    assert got == {"long": WHOLE.sub("", text), None: "a"} and work.rounds <= 5


SPANS = [
    ("requests.get(u, headers={'a': f(1)},\n  timeout=3)", []), ("x = requests.get(\n u)\ny = requests.put(u,\n timeout=1)", [("no-timeout", 1)]),
    ("session.get(u)\nmyrequests.get(u)\n", []), ("def f(a, b={1: [2]},\n c=g(x=[])):\n  pass\n", [("mutable-default", 1)]),
    ("with open(a) as f, open(b) as g:\n  x = open(c)\n", [("open", 2)]), ("with closing(open(a)) as f:\n  pass\n", [("open", 1)]),
    ("open(a) if x else os.open(b)\n", [("open", 1), ("open", 1)]), ("# eval(x)\ns = 'exec(y)'\n", []),
    ("try:\n  a()\nexcept (A,\n   B):\n  pass\n", []), ("try:\n  a()\nexcept A:\n\n  # nothing\n  pass\nb()\n", [("swallowed", 3)]),
    ("def f(a=()):\n  b = [1]\n  return f(b=[2])\n", []), ("f(\n) ) eval(\n", [("eval", 2)]),
]


def test_rules_over_spans(spark):
    df = spark.createDataFrame([(i, "python", c) for i, (c, _) in enumerate(SPANS)], "snippet_id int, language string, code string")
    got = sorted((r["snippet_id"], r["rule"], r["line"]) for r in lint.lint_python_spans(df).collect())
    assert got == sorted((i, rule, line) for i, (_, found) in enumerate(SPANS) for rule, line in found)


def test_inverted_file(spark):
    """Recall against the exact search with an eighth of the cells; all cells give the exact answer."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    points = centres[rng.integers(0, 40, 2_400)] + 0.25 * rng.normal(size=(2_400, 12))
    rows = [(f"t{i % 2}", i, [float(x) for x in p]) for i, p in enumerate(points)] + [("t0", 9_000, [0.0] * 12)]
    corpus = spark.createDataFrame(rows, "tenant string, doc_id bigint, vector array<double>")
    queries = corpus.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in search.vector_search(queries, corpus).collect()}
    near = {(r.query_id, r.doc_id) for r in search.vector_search_approx(queries, corpus).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    every = {(r.query_id, r.doc_id) for r in search.vector_search_approx(queries, corpus, probes=1.0).collect()}
    assert every == exact
    assert search.vector_search_approx(queries, corpus.limit(0)).count() == 0


def test_cut_of_a_long_text_takes_one_walk(spark):
    """Two million letters in pieces of five: a walk from the start for every piece took minutes."""
    long = "aé😀\n<" * 400_000
    rows = [(60, long), (61, None), (119, ""), (62, "a\r\nb" * 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, answer string").repartition(1)
    start = time.monotonic()
    got = {}
    for r in texts._cut(df).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("p")).collect():
        got[r.doc_id] = [(x.n, x.piece) for x in r.p]
    assert time.monotonic() - start < 40
    assert got[60] == [(i, "aé😀\n<") for i in range(400_000)]
    assert got[61] == [(None, None)] and got[119] == [(0, "")]
    assert [p for _, p in got[62]] == ["a\r\nba\r\n", "ba\r\nba\r", "\nb"]
