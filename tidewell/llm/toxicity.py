"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Input of a step: an embedding of the word (hashed) beside the mean embedding of its character sequences of 3 to 5 bytes (hashed,
ends of the word included), so unseen words of a known stem are understood.  Two GRUs read a window in both directions, attention
pools their states, a logistic unit scores the window.  A text's score is the highest score of all its overlapping windows
of ``WINDOW`` words, one at every word (``STEP`` apart).  The same word has the same input anywhere, so inputs are computed once per distinct word
of a chunk of text, and windows run through the network in batches.

Training uses at most ``SAMPLE`` toxic and twice as many other labelled rows that have a text with words, chosen by a hash of
their id.  A text of up to ``TRAIN_BYTES`` bytes is taken whole; of a longer one, executors draw windows from the whole text by
a hash of their place, as many as fit in those bytes.  This bounded sample is fitted on the driver.  Labels belong to texts, not windows: the first passes take random
windows, later ones the highest window of a toxic text and the highest and some random windows of another one.
The fitted network (under 4 MB) is broadcast; every text is scored whole on the executors.

Defined results: a null or empty text, or one without letters and digits, scores 0; null labels do not train; without labels of
both kinds every score is 0; a null id counts as not held out; repeated rows give a row each; an id with several labels or texts
trains with its smallest label and, for that, its smallest text; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fold, map_rows, share, shared, small_batches, written
from tidewell.llm.words import WordHasher, mix, series

WINDOW, STEP = 5, 1
WORD_ROWS, WORD_SIZE = 1 << 14, 6
GRAM_ROWS, GRAM_SIZE, GRAMS = 1 << 15, 14, (3, 4, 5)
STATE = 8
SAMPLE, TRAIN_BYTES = 1500, 8000
PASSES, EARLY = 8, 3
BATCH = 2048
CHUNK = 1 << 20  # bytes of text looked at together


class Words:
    """Distinct words of some texts: the word of every place, and the hashed inputs of every distinct word."""

    def __init__(self) -> None:
        self.hasher = WordHasher(letters=True)
        self.byte_values = series(7, 256)
        self.turns = series(8, 8) | np.uint64(1)

    def read(self, data: np.ndarray, texts: np.ndarray):
        """(word number by place, words before each text, word rows, gram rows, first gram of each word)."""
        hashes, starts, before = self.hasher.hash(data, texts)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        word_rows = (distinct % np.uint64(WORD_ROWS)).astype(np.int64)
        return number, before, starts, word_rows, *self.grams(data, texts, starts[first])

    def read_many(self, texts: list[bytes]):
        """The same for a list of texts, read a chunk at a time: (word numbers, words before each text, rows, grams, begins)."""
        known: dict[int, int] = {}
        numbers, before, word_rows, gram_rows, begins = [], [], [], [], []
        words = grams = at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= CHUNK):
                size += len(texts[stop])
                stop += 1
            data = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
            offsets = np.cumsum([0] + [len(t) for t in texts[at:stop]])[:-1]
            hashes, starts, first_words = self.hasher.hash(data, offsets)
            distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
            old = len(known)
            ids = np.array([known.setdefault(h, len(known)) for h in distinct.tolist()], np.int32)
            new = ids >= old
            rows, begin = self.grams(data, offsets, starts[first[new]])
            numbers.append(ids[number])
            before.append(first_words + words)
            word_rows.append((distinct[new] % np.uint64(WORD_ROWS)).astype(np.int32))
            gram_rows.append(rows.astype(np.int32))
            begins.append(begin + grams)
            words, grams, at = words + len(hashes), grams + len(rows), stop
        return tuple(np.concatenate(x) for x in (numbers, before, word_rows, gram_rows, begins))

    def grams(self, data: np.ndarray, texts: np.ndarray, starts: np.ndarray):
        """Hashed character sequences of the words that begin at ``starts``."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        limit = np.append(texts[1:], len(data))[np.searchsorted(texts, starts, "right") - 1]
        breaks = np.flatnonzero(self.hasher.space[data])
        ends = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
        sizes = np.minimum(ends, limit) - starts
        padded = sizes + 2
        begin = np.concatenate([[0], np.cumsum(padded)[:-1]])
        total = int(padded.sum())
        inner = np.arange(total) - np.repeat(begin, padded)  # place in the padded word
        letters = np.full(total, 32, np.uint8)
        is_letter = (inner > 0) & (inner <= np.repeat(sizes, padded))
        letters[is_letter] = self.hasher.fold[data[np.repeat(starts, padded)[is_letter] + inner[is_letter] - 1]]
        values = self.byte_values[letters]
        room = np.repeat(padded, padded) - inner  # bytes of the padded word from here on
        owner = np.repeat(np.arange(len(starts)), padded)
        rows, owners = [], []
        for size in GRAMS:
            whole = np.flatnonzero(room >= size)
            code = np.full(len(whole), np.uint64(size))
            for i in range(size):
                code += values[whole + i] * self.turns[i]
            rows.append((mix(code) % np.uint64(GRAM_ROWS)).astype(np.int64))
            owners.append(owner[whole])
        rows, owners = np.concatenate(rows), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return rows[order], np.searchsorted(owners[order], np.arange(len(starts)))


def windows_of(before: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, words, text) of every window; ``before`` counts the words before each text."""
    counts = np.diff(np.append(before, total))
    per_text = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STEP)), 0)
    text = np.repeat(np.arange(len(before)), per_text)
    index = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = before[text] + index * STEP
    return first, np.minimum(WINDOW, before[text] + counts[text] - first), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, the forward pass and its gradient."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        size = WORD_SIZE + GRAM_SIZE
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.word = draw(WORD_ROWS, WORD_SIZE, scale=0.05)
        self.gram = draw(GRAM_ROWS, GRAM_SIZE, scale=0.1)
        self.dense = {}
        for way in "fb":
            self.dense[f"w{way}"] = draw(size, 3 * STATE, scale=size**-0.5)
            self.dense[f"u{way}"] = draw(STATE, 3 * STATE, scale=STATE**-0.5)
            self.dense[f"c{way}"] = np.zeros(3 * STATE, np.float32)
        self.dense["attend"] = draw(2 * STATE, scale=0.3)
        self.dense["out"] = draw(2 * STATE, scale=0.3)
        self.dense["bias"] = np.zeros(1, np.float32)

    def inputs(self, word_rows: np.ndarray, gram_rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The input vector of every distinct word."""
        counts = np.diff(np.append(begin, len(gram_rows)))[:, None]
        out = np.empty((len(word_rows), WORD_SIZE + GRAM_SIZE), np.float32)
        out[:, :WORD_SIZE] = self.word[word_rows]
        for at in range(0, len(word_rows), 8192):  # a distinct word has at least one sequence
            stop = min(at + 8192, len(word_rows))
            rows = gram_rows[begin[at]:begin[stop] if stop < len(begin) else len(gram_rows)]
            sums = np.add.reduceat(self.gram[rows], begin[at:stop] - begin[at], axis=0)
            out[at:stop, WORD_SIZE:] = sums / np.sqrt(counts[at:stop])
        return out

    def run(self, places: np.ndarray, sizes: np.ndarray, projected: dict, keep: bool = False):
        """Logits of windows; ``places`` (windows x WINDOW) number the distinct words, ``projected`` their inputs times w."""
        p = self.dense
        count, length = places.shape
        mask = np.arange(length)[None, :] < sizes[:, None]
        states = np.zeros((length, count, 2 * STATE), np.float32)
        kept = {"f": [], "b": []}
        for way, order in (("f", range(length)), ("b", reversed(range(length)))):
            part = slice(0, STATE) if way == "f" else slice(STATE, 2 * STATE)
            u, h = p[f"u{way}"], np.zeros((count, STATE), np.float32)
            for t in order:
                x = projected[way][places[:, t]]
                g = h @ u
                gates = _sigmoid(x[:, :2 * STATE] + g[:, :2 * STATE])
                z, r = gates[:, :STATE], gates[:, STATE:]
                n = np.tanh(x[:, 2 * STATE:] + r * g[:, 2 * STATE:])
                new = np.where(mask[:, t, None], n + z * (h - n), h)
                if keep:
                    kept[way].append((t, h, z, r, n, g[:, 2 * STATE:]))
                h = new
                states[t, :, part] = h
        energy = np.where(mask.T, states @ p["attend"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        logits = pooled @ p["out"] + p["bias"][0]
        return (logits, (mask, states, kept, weight, pooled)) if keep else logits

    def prepared(self, projected: dict) -> dict:
        """Per way: what :meth:`logits` needs of every distinct word, its state as the first word of a window, and u.

        Gates are stored at half their size, as a sigmoid is half a tanh of the half.
        """
        out = {}
        for way in "fb":
            x, u = projected[way].copy(), self.dense[f"u{way}"].copy()
            x[:, :2 * STATE] *= 0.5
            u[:, :2 * STATE] *= 0.5
            n = np.tanh(x[:, 2 * STATE:])
            out[way] = x, n - (0.5 + 0.5 * np.tanh(x[:, :STATE])) * n, u
        return out

    def logits(self, places: np.ndarray, prepared: dict) -> np.ndarray:
        """What :meth:`run` gives for windows without a gap at their end; the first step is looked up by word."""
        count, length = places.shape
        states = np.empty((length, count, 2 * STATE), np.float32)
        for way, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            part = slice(0, STATE) if way == "f" else slice(STATE, 2 * STATE)
            x, begin, u = prepared[way]
            h = None
            for t in order:
                word = places[:, t]
                if h is None:
                    h = begin[word]
                else:
                    own = x[word]
                    g = h @ u
                    gates = g[:, :2 * STATE]
                    gates += own[:, :2 * STATE]
                    np.tanh(gates, out=gates)
                    gates *= 0.5
                    gates += 0.5
                    n = gates[:, STATE:] * g[:, 2 * STATE:]
                    n += own[:, 2 * STATE:]
                    np.tanh(n, out=n)
                    h -= n
                    h *= gates[:, :STATE]
                    h += n
                states[t, :, part] = h
        energy = states @ self.dense["attend"]
        energy -= energy.max(axis=0)
        weight = np.exp(energy, out=energy)
        votes = states @ self.dense["out"]
        return (weight * votes).sum(axis=0) / weight.sum(axis=0) + self.dense["bias"][0]

    def projected(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {way: inputs @ self.dense[f"w{way}"] + self.dense[f"c{way}"] for way in "fb"}

    def gradient(self, places: np.ndarray, inputs: np.ndarray, slope: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the inputs, for the slope of the loss at each logit."""
        p = self.dense
        mask, states, steps, weight, pooled = kept
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["bias"][0] = slope.sum()
        grads["out"] = pooled.T @ slope
        d_pooled = slope[:, None] * p["out"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled + d_energy[:, :, None] * p["attend"]
        grads["attend"] = np.einsum("tc,tcs->s", d_energy, states)
        d_inputs = np.zeros_like(inputs)
        for way in "fb":
            part = slice(0, STATE) if way == "f" else slice(STATE, 2 * STATE)
            u, w = p[f"u{way}"], p[f"w{way}"]
            carry = np.zeros((len(places), STATE), np.float32)
            for t, h, z, r, n, g in reversed(steps[way]):
                d = carry + d_states[t, :, part]
                m = mask[:, t, None]
                d_new = np.where(m, d, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * g * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                carry = np.where(m, d_new * z, d) + d_g @ u.T
                grads[f"u{way}"] += h.T @ d_g
                grads[f"c{way}"] += d_x.sum(axis=0)
                grads[f"w{way}"] += inputs[places[:, t]].T @ d_x
                np.add.at(d_inputs, places[:, t], d_x @ w.T)
        return grads, d_inputs


def score_windows(net: Network, number: np.ndarray, first: np.ndarray, sizes: np.ndarray, projected: dict) -> np.ndarray:
    out = np.empty(len(first), np.float32)
    prepared = net.prepared(projected)
    whole, short = np.flatnonzero(sizes == WINDOW), np.flatnonzero(sizes < WINDOW)
    inner = np.arange(WINDOW)
    for at in range(0, len(whole), BATCH):
        w = whole[at:at + BATCH]
        out[w] = net.logits(number[first[w][:, None] + inner], prepared)
    for at in range(0, len(short), BATCH):  # the only windows of short texts
        w = short[at:at + BATCH]
        out[w] = net.run(number[np.minimum(first[w][:, None] + inner, len(number) - 1)], sizes[w], projected)
    return out


def drawn(text: bytes, limit: int, seed: int = 0) -> list[bytes]:
    """A text of at most ``limit`` bytes; else windows drawn from all of it by hash, that many bytes of them, in order."""
    if len(text) <= limit:
        return [text]
    hasher, at, starts = WordHasher(letters=True), 0, []
    for piece in hasher._pieces(np.frombuffer(text, np.uint8)):
        starts.append(hasher.hash(piece, np.zeros(1, np.int64))[1] + at)
        at += len(piece)
    starts = np.concatenate(starts)
    first, sizes, _ = windows_of(np.zeros(1, np.int64), len(starts))
    ends = np.append(starts, len(text))[first + sizes]
    apart = bytes(32 if hasher.space[i] else i for i in range(256))
    order = np.argsort(mix(np.arange(len(first), dtype=np.uint64) + np.uint64(seed) + series(9, 1)), kind="stable")
    chosen, room = {}, limit
    for i in order.tolist():
        window = b" ".join(text[starts[first[i]]:ends[i]].translate(apart).split())
        if len(window) > room:
            if not chosen:
                chosen[i] = window[:limit]
            break
        chosen[i], room = window, room - len(window)
    return [chosen[i] for i in sorted(chosen)]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5, owner: np.ndarray | None = None) -> Network | None:
    """Fit the network to whole-text labels; ``owner`` (rising) gives the label's place for each text, if a label has several."""
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    number, before, word_rows, gram_rows, begin = Words().read_many(texts)
    first, sizes, text = windows_of(before, len(number))
    if not len(first):
        return None
    if owner is not None:
        text = owner[text]
    grams_end = np.append(begin[1:], len(gram_rows))
    net = Network()
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.dense.items()}
    squares = {"word": np.full(WORD_ROWS, 1e-4, np.float32), "gram": np.full(GRAM_ROWS, 1e-4, np.float32)}
    bounds = np.searchsorted(text, np.arange(len(labels) + 1))
    has = np.flatnonzero(np.diff(bounds))
    steps = 0
    for turn in range(PASSES):
        chosen = []
        if turn >= EARLY:
            logits = score_windows(net, number, first, sizes, net.projected(net.inputs(word_rows, gram_rows, begin)))
        for t in has:
            a, b = bounds[t], bounds[t + 1]
            few = rng.integers(a, b, 4 if turn < EARLY else 2)
            if turn >= EARLY:
                top = a + np.argsort(-logits[a:b])[:2]
                few = top[:1] if labels[t] else np.concatenate([top, few])
            chosen.append(np.unique(few))
        chosen = rng.permutation(np.concatenate(chosen))
        truth = labels[text[chosen]].astype(np.float32)
        balance = np.where(truth > 0, 0.5 / max(truth.mean(), 1e-6), 0.5 / max(1 - truth.mean(), 1e-6)).astype(np.float32)
        for at in range(0, len(chosen), 64):
            pick = chosen[at:at + 64]
            used, places = np.unique(number[np.minimum(first[pick][:, None] + np.arange(WINDOW), len(number) - 1)], return_inverse=True)
            places = places.reshape(len(pick), WINDOW)
            spans = [gram_rows[begin[w]:grams_end[w]] for w in used]
            rows, counts = np.concatenate(spans), np.array([len(s) for s in spans])
            starts = np.cumsum(counts) - counts
            inputs = net.inputs(word_rows[used], rows, starts)
            logit, kept = net.run(places, sizes[pick], net.projected(inputs), keep=True)
            slope = (_sigmoid(logit) - truth[at:at + 64]) * balance[at:at + 64] / len(pick)
            grads, d_inputs = net.gradient(places, inputs, slope, kept)
            steps += 1
            for k, g in grads.items():
                one, two = moments[k]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                net.dense[k] -= 0.01 * (one / (1 - 0.9**steps)) / (np.sqrt(two / (1 - 0.999**steps)) + 1e-6)
            d_gram = np.repeat(d_inputs[:, WORD_SIZE:] / np.sqrt(counts)[:, None], counts, axis=0)
            for table, at_rows, d in ((net.word, word_rows[used], d_inputs[:, :WORD_SIZE]), (net.gram, rows, d_gram)):
                name = "word" if table is net.word else "gram"
                touched, back = np.unique(at_rows, return_inverse=True)
                total = np.zeros((len(touched), table.shape[1]), np.float32)
                np.add.at(total, back, d)
                squares[name][touched] += (total * total).mean(axis=1)
                table[touched] -= 0.05 * total / np.sqrt(squares[name][touched])[:, None]
    return net


def score_texts(net: Network, words: Words, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) for groups of rows."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else []
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[last])
        scores = np.zeros(last - row)
        if end - begin <= CHUNK or last > row + 1:
            _, best = _best(net, words, data[begin:end], offsets[row:last] - begin)
            scores = best
        else:  # one very long text: pieces that share a window's words
            while begin < end:
                cut = min(begin + CHUNK, end)
                space = np.flatnonzero(words.hasher.space[data[begin:cut]])
                if cut < end and len(space):
                    cut = begin + int(space[-1]) + 1
                starts, best = _best(net, words, data[begin:cut], np.zeros(1, np.int64))
                scores = np.maximum(scores, best)
                if cut >= end:
                    break
                begin = begin + int(starts[-WINDOW]) if len(starts) > 2 * WINDOW else cut
        yield row, scores
        row = last


def _best(net: Network, words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number, before, starts, *rows = words.read(data, offsets)
    best = np.zeros(len(offsets))
    if len(number):
        first, sizes, text = windows_of(before, len(number))
        logits = score_windows(net, number, first, sizes, net.projected(net.inputs(*rows)))
        np.maximum.at(best, text, _sigmoid(logits.astype(np.float64)))
    return starts, best


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic",
        train_bytes: int = TRAIN_BYTES):
    """Train on a bounded sample of the labelled rows with a text outside the held-out fold."""
    known = labels.select(F.col(key).alias("_id"), F.col(label).alias("_label")).where("_id is not null and _label is not null")
    known = known.where(fold(F.col("_id")) > 0)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").rlike(r"[A-Za-z0-9]|[^\x00-\x7F]"))
    known = written(known.join(rows.select("_id"), "_id", "left_semi"), "labelled").withColumn("_order", F.xxhash64("_id"))
    pick = lambda value, count: known.where(F.col("_label") == value).orderBy("_order", "_id").limit(count)
    chosen = pick(1, sample).unionByName(pick(0, 2 * sample)).select("_id", "_label")  # 3 * sample rows at most
    found = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("_label", "_text")).alias("r"))
    found = found.select("_id", "r._label", F.xxhash64("_id").alias("_seed"), "r._text")

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for id_, label_, seed, body in rows:
            yield id_, label_, drawn(body.encode(), train_bytes, seed % (1 << 64))

    id_type, label_type = (found.schema[c].dataType.simpleString() for c in ("_id", "_label"))
    with small_batches(docs.sparkSession):
        found = map_rows(found, f"_id {id_type}, _label {label_type}, _parts array<binary>", cut).collect()
    found.sort(key=lambda r: r["_id"])
    owner = np.repeat(np.arange(len(found)), [len(r["_parts"]) for r in found])
    return train([bytes(t) for r in found for t in r["_parts"]], np.array([r["_label"] for r in found], np.int64), owner=owner)


def score(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every row."""
    return _scored(docs.select(key, F.col(text).alias("_text")), net).drop("_text").withColumnRenamed("_score", "score")


def _scored(rows: DataFrame, net: Network | None) -> DataFrame:
    """All columns, the last of which is the text, and ``_score``."""
    if net is None:
        return rows.withColumn("_score", F.lit(0.0))
    model = share(rows.sparkSession, net)  # under 4 MB by the sizes above
    schema = rows.withColumn("_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = Words(), shared(model)
        for batch in batches:
            for first, scores in score_texts(net, words, batch.column(batch.num_columns - 1)):
                part = batch.slice(first, len(scores))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*batch.schema.names, "_score"])

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out flag, score and prediction of every document."""
    scored = written(score(docs, fit(docs, labels)), "toxicity")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that score under 0.5, with all their columns."""
    net = fit(docs, labels)
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("_text"))
    clean = _scored(rows, net).where("_score < 0.5")
    return clean.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
