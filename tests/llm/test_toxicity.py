"""The network's gradient, its windows, and accuracy on held-out rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import toxicity as tox


def test_gradient():
    rng = np.random.default_rng(3)
    net = tox.Network()
    net.dense = {k: v.astype(np.float64) for k, v in net.dense.items()}
    inputs = rng.standard_normal((9, tox.WORD_SIZE + tox.GRAM_SIZE))
    places, sizes = rng.integers(0, 9, (4, tox.WINDOW)), np.array([1, 2, tox.WINDOW, 3])
    aim = rng.standard_normal(4)
    loss = lambda: float((net.run(places, sizes, net.projected(inputs)) * aim).sum())
    _, kept = net.run(places, sizes, net.projected(inputs), keep=True)
    grads, d_inputs = net.gradient(places, inputs, aim, kept)
    for array, grad in [(inputs, d_inputs)] + [(net.dense[k], grads[k]) for k in net.dense]:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old, step = array[at], 1e-3
            array[at] = old + step
            high = loss()
            array[at] = old - step
            low = loss()
            array[at] = old
            assert abs((high - low) / (2 * step) - grad[at]) < 2e-3 * max(1, abs(grad[at]))


def test_windows():
    w = tox.WINDOW
    first, sizes, text = tox.windows_of(np.array([0, 0, 3, 3 + w + 4]), 3 + w + 5)
    assert text.tolist() == [1, *[2] * 5, 3] and first.tolist() == [0, *range(3, 8), 3 + w + 4] and sizes.tolist() == [3, *[w] * 5, 1]


def plain_score(net, text):
    """The highest of all windows, each run on its own, word by word, in plain loops."""
    words = re.findall(r"[A-Za-z0-9\x80-\xff]+", text.encode().decode("latin-1"))
    if not words:
        return 0.0
    read = tox.Words()
    inputs = []
    for w in words:
        _, _, _, *rows = read.read(np.frombuffer(w.encode("latin-1"), np.uint8), np.zeros(1, np.int64))
        inputs.append(net.inputs(*rows)[0].astype(float))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    best = 0.0
    for start in range(max(1, len(words) - tox.WINDOW + 1)):
        window = inputs[start:start + tox.WINDOW]
        states = [[] for _ in window]
        for way in "fb":
            w, u, c = (net.dense[f"{k}{way}"].astype(float) for k in "wuc")
            h = [0.0] * tox.STATE
            for t in range(len(window)) if way == "f" else reversed(range(len(window))):
                x = [sum(a * b for a, b in zip(window[t], col)) + d for col, d in zip(w.T.tolist(), c.tolist())]
                g = [sum(a * b for a, b in zip(h, col)) for col in u.T.tolist()]
                z = [sigmoid(x[i] + g[i]) for i in range(tox.STATE)]
                r = [sigmoid(x[i] + g[i]) for i in range(tox.STATE, 2 * tox.STATE)]
                n = [math.tanh(x[i + 2 * tox.STATE] + r[i] * g[i + 2 * tox.STATE]) for i in range(tox.STATE)]
                h = [(1 - z[i]) * n[i] + z[i] * h[i] for i in range(tox.STATE)]
                states[t] += h
        energy = [sum(a * b for a, b in zip(s, net.dense["attend"].tolist())) for s in states]
        weight = [math.exp(e - max(energy)) for e in energy]
        pooled = [sum(w * s[i] for w, s in zip(weight, states)) / sum(weight) for i in range(2 * tox.STATE)]
        best = max(best, sigmoid(sum(a * b for a, b in zip(pooled, net.dense["out"].tolist())) + float(net.dense["bias"][0])))
    return best


def test_scores_against_single_windows():
    texts, _ = made(12, 5)
    texts = [t[:400] for t in texts] + ["", "one", "a b c d e f g h", "a b c d e f g h i", "Ünïcode, dots... AND-signs 12 x"]
    net = tox.train([t.encode() for t in made(60, 8)[0]], np.array(made(60, 8)[1]))
    got = np.concatenate([s for _, s in tox.score_texts(net, tox.Words(), pa.array(texts))])
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)


def made(count, seed):
    """Texts of random syllables; a third holds words of a stem with unseen endings."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(["an", "th", "re", "é", "on", "ti"]) for _ in range(n))
    texts, toxic = [], []
    for _ in range(count):
        words = [word(rng.randint(1, 4)) for _ in range(rng.randint(5, 150))]
        bad = rng.random() < 0.33
        for _ in range(3 if bad else 0):
            words.insert(rng.randint(0, len(words)), "Zork" + word(2))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


@pytest.fixture(scope="module")
def scored(spark):
    texts, toxic = made(900, 1)
    texts += [None, "", " .!", "zorkanon " * 3, texts[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(900, None), (901, 1), (902, 0)], "doc_id long, toxic int")
    return texts, toxic, docs, labels, tox.report(docs, labels).orderBy("doc_id").collect()


def test_held_out(scored):
    texts, toxic, _, _, rows = scored
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows[:900] if r.held_out]
    right = sum(r.predicted == toxic[r.doc_id] for r in held) / len(held)
    assert right > 0.93
    assert [r.score for r in rows[900:903]] == [0, 0, 0] and rows[903].predicted == 1 and abs(rows[904].score - rows[0].score) < 1e-6


def test_filter(scored, spark):
    _, _, docs, labels, rows = scored
    kept = tox.remove_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in rows if not r.predicted]
    assert tox.report(docs.where("false"), labels).count() == 0
    assert {r.score for r in tox.report(docs.limit(5), labels.where("false")).collect()} == {0}


def test_long_text():
    texts, toxic = made(300, 2)
    net = tox.train([t.encode() for t in texts], np.array(toxic))
    clean = " ".join(t for t, x in zip(texts, toxic) if not x)
    long = (clean + " ") * (2 * tox.CHUNK // len(clean.encode()) + 1)
    cut = len(long) // 2 - 40
    dirty = long[:cut] + " zorkthan zorkre zorkonon " + long[cut:]
    score = lambda t: float(next(tox.score_texts(net, tox.Words(), pa.array([t])))[1][0])
    assert score(dirty) >= score(long) and score(dirty) > 0.5


def test_drawn():
    words = [f"w{i}" for i in range(5000)]
    text = ", ".join(words).encode()
    assert tox.drawn(text, len(text)) == [text]
    parts = tox.drawn(text, 6000)
    assert 3000 < sum(map(len, parts)) <= 6000 and parts == tox.drawn(text, 6000) != tox.drawn(text, 6000, 1)
    at = [words.index(p.decode().split()[0]) for p in parts]
    assert at == sorted(at) and at[0] < 1000 and at[-1] > 4000
    assert all(p.decode().split() == words[i:i + tox.WINDOW] for i, p in zip(at, parts))
    assert tox.drawn("é".encode() * 5000, 300) == ["é".encode() * 150]


def test_labelled_texts_are_long(spark):
    """Every labelled text is over the limit, and most of the first labels have no text."""
    rng = random.Random(8)
    clean = [t.split() for t, x in zip(*made(400, 6)) if not x]
    texts, toxic = [], []
    for i in range(160):
        words = [w for _ in range(30) for w in rng.choice(clean)]
        toxic.append(i % 2)
        texts.append(" ".join(w for i, x in enumerate(words) for w in ([x, f"Zork{x}"] if toxic[-1] and i % 6 == 0 else [x])))
    assert min(map(len, texts)) > tox.TRAIN_BYTES
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, t) for i, t in enumerate(toxic)] + [(i, i % 2) for i in range(1000, 4000)], "doc_id long, toxic int")
    net = tox.fit(docs, labels, sample=60)
    rows = tox.score(docs, net).collect()
    assert net is not None and sum((r.score >= 0.5) == toxic[r.doc_id] for r in rows) / len(rows) > 0.93
