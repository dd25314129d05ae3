"""Language-model scores from a probabilistic suffix tree over words.

The tree has a head, which is broadcast, and a tail, which grows with the corpus and stays dealt out.

Head.  Symbols are the words that make up at least ``SYMBOL`` of the training tokens, the end of a text and one class for all other
words (a rare word's share of its class is its smoothed count).  Contexts grow backwards level by level: a context is a
candidate if it makes up at least ``SYMBOL`` of the tokens, and stays in the tree if its next-symbol distribution diverges from
that of its longest proper suffix by ``DIVERGENCE`` nats or more (a context's suffixes stay with it).  Next-symbol counts
above ``ENTRY`` of the tokens are stored; the rest of a context's mass, and ``PRIOR`` more, goes to its suffix, so every
distribution sums to one.  These thresholds are shares, so the broadcast has a proven bound at any size: 1/HEAD words, 1/SYMBOL
contexts and 1/ENTRY counts a level.

Tail.  All other contexts of up to ``DEPTH`` words, each word at least ``HEAD`` of the tokens, by absolute counts: a context seen
``LEAST`` times or more stays if its next-word distribution diverges from that of its suffix such that its training tokens, each left
out of the counts that judge it, gain ``GAIN`` nats or more (its suffixes stay with it).  Next words are words, not classes; words below
``HEAD`` are one class.  The shortest suffix of a context that is no candidate of the head is the root
of a subtree; a subtree makes up less than ``SYMBOL`` of the training tokens.  Tokens are sent to the shard of their root, which builds its
subtrees, scores its tokens and returns one sum per text.  Shards have ``SHARD`` tokens on average, so their number grows with the corpus.

A token is scored in its longest suffix state.  Counts come from all training texts.  Words below ``HEAD`` stay in tables: their counts
meet the texts that hold them in one join, by word.

Defined results: a null text is empty and has one token, its end; a null id trains and is not held out; repeated rows give a row
each; without training texts every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidewell.llm.common import fold, share, shared, written
from tidewell.llm.words import WordHasher, mix

HELD_OUT = 1
HEAD, SYMBOL, ENTRY = 1e-6, 2e-4, 2e-6
DEPTH = 3
DIVERGENCE = 0.005
PRIOR = 5.0
LEAST = 2
GAIN = 2.0
SHARD = 1_000_000
BITS = 20  # of a word's number; there are at most 1 / HEAD words, and DEPTH of them make one code
RARE, END, FIRST = 0, 1, 2  # symbols; frequent words count from FIRST
HELD_COUNTS = 1 << 19  # distinct codes a task holds before it hands them on
HELD_TOKENS = 1 << 19  # tokens for the tail a task holds before it hands them on


@dataclass
class Level:
    """Contexts of one length: ``codes`` (sorted; shorter context * symbols + its last word), totals and next symbols."""

    codes: np.ndarray
    total: np.ndarray
    entries: np.ndarray  # sorted: context * symbols + next symbol
    counts: np.ndarray
    rest: np.ndarray = field(init=False)
    kept: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.rest = self.total.astype(np.float64)
        self.kept = np.zeros(len(self.total), bool)


@dataclass
class Tree:
    tokens: int
    distinct: int
    head: np.ndarray  # sorted word hashes
    head_counts: np.ndarray
    head_symbols: np.ndarray
    symbols: int
    first: np.ndarray  # probability of each symbol without context
    rare_scale: float  # log10 of what a rare word's count is divided by
    levels: list[Level]
    others: float  # share of the rare class that belongs to words outside the head

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the head, from FIRST on; RARE outside."""
        if not len(self.head):
            return np.full(len(hashes), RARE)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return np.where(self.head[at] == hashes, at + FIRST, RARE)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """By word number: its symbol, and its share of that symbol's tokens."""
        shares = np.where(self.head_symbols == RARE, (self.head_counts + 0.5) / 10 ** self.rare_scale, 1.0)
        return np.concatenate([[RARE, END], self.head_symbols]), np.concatenate([[self.others, 1.0], shares])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and training count of words; the count is -1 outside the head."""
        numbers = self.numbers(hashes)
        known = numbers != RARE
        at = np.where(known, numbers - FIRST, 0)
        if not len(self.head):
            return numbers, np.full(len(hashes), -1)
        return np.where(known, self.head_symbols[at], RARE), np.where(known, self.head_counts[at], -1)

    def states(self, symbols: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """For each level the context (or -1) that precedes every token; ``place`` is the token's place in its text."""
        before = np.full(len(symbols), RARE)
        before[1:] = symbols[:-1]
        before[place == 0] = RARE
        out = [np.where(before >= FIRST, before, -1)]
        for level in self.levels[1:]:
            shorter = np.full(len(symbols), -1)
            shorter[1:] = out[-1][:-1]
            shorter[place == 0] = -1
            code = np.where((shorter >= 0) & (before >= FIRST), shorter * self.symbols + before, -1)
            out.append(_find(level.codes, code))
        return out

    def suffix(self, depth: int) -> np.ndarray:
        """The context of ``levels[depth - 1]`` that each context of ``levels[depth]`` ends with."""
        shorter, last = np.divmod(self.levels[depth].codes, self.symbols)
        if depth == 1:
            return last
        return _find(self.levels[depth - 1].codes, self.suffix(depth - 1)[shorter] * self.symbols + last)

    def chance(self, depth: int, contexts: np.ndarray, symbols: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """P(symbol | context), given the chances in the next shorter state; -1 or a dropped context changes nothing."""
        level = self.levels[depth]
        there = contexts >= 0
        there[there] = level.kept[contexts[there]]
        c = np.where(there, contexts, 0)
        if not len(level.total) or not there.any():
            return shorter
        at = _find(level.entries, np.where(there, c * self.symbols + symbols, -1))
        count = np.where(at >= 0, level.counts[np.maximum(at, 0)] if len(level.counts) else 0, 0)
        value = (count + (PRIOR + level.rest[c]) * shorter) / (level.total[c] + PRIOR)
        return np.where(there, value, shorter)

    def chances(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        p = self.first[symbols]
        for depth, contexts in enumerate(self.states(symbols, place)):
            p = self.chance(depth, contexts, symbols, p)
        return p


def _find(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code in a sorted table, else -1."""
    if not len(table):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return np.where(table[at] == codes, at, -1)


def _with_ends(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with the end of every text put in, the place of each in its text, and where each text starts."""
    all_symbols = np.insert(symbols, bounds[1:], END)
    starts = bounds[:-1] + np.arange(len(bounds) - 1)
    sizes = np.diff(bounds) + 1
    return all_symbols, np.arange(len(all_symbols)) - np.repeat(starts, sizes), starts


def _words():
    return lambda hashes, bounds: hashes.view(np.int64)


def _next_symbols(model):
    """Longest candidate context of every token with the token's symbol, as one number."""

    def start():
        tree = shared(model)

        def codes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            seen, place, _ = _with_ends(tree.look_up(hashes)[0], bounds)
            context = tree.states(seen, place)[-1]
            return (context * tree.symbols + seen)[context >= 0]

        return codes_of

    return start


def _counted(texts: DataFrame, start: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """``code`` and ``n`` over all texts; each task adds up what it can hold before it hands counts on.

    ``start`` gives, in the task, the function from word hashes and text bounds to codes.
    """

    def emit(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at:at + 100_000]), pa.array(counts[at:at + 100_000])], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, codes_of = WordHasher(), start()
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def add_up() -> None:
            nonlocal codes, counts
            new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (codes[:0], counts[:0])
            waiting.clear()
            both = np.concatenate([codes, new])
            codes, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(codes)).astype(np.int64)

        for batch in batches:
            for _, hashes, bounds in hasher.column(batch.column(0)):
                waiting.append(codes_of(hashes, bounds))
                if sum(map(len, waiting)) >= HELD_COUNTS:
                    add_up()
                    if len(codes) >= HELD_COUNTS:
                        yield from emit(codes, counts)
                        codes, counts = codes[:0], counts[:0]
        add_up()
        yield from emit(codes, counts)

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2)
    return table[:, 0], table[:, 1]


def learn(texts: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree, and the counts (``code``, ``n``) of the words that are not in its head.  ``texts`` has one column."""
    spark = texts.sparkSession
    words = written(_counted(texts, _words), "word-counts")
    ends = texts.count()
    in_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = in_words + ends, distinct + (ends > 0)
    least = HEAD * tokens
    head, head_counts = _arrays(words.where(F.col("n") >= least).collect())  # 1 / HEAD rows at most
    order = np.argsort(head.view(np.uint64))
    head, head_counts = head.view(np.uint64)[order], head_counts[order]
    frequent = head_counts >= SYMBOL * tokens
    head_symbols = np.zeros(len(head), np.int64)
    head_symbols[frequent] = FIRST + np.arange(frequent.sum())
    symbols = FIRST + int(frequent.sum())
    counts = np.zeros(symbols)
    counts[FIRST:], counts[END] = head_counts[frequent], ends
    counts[RARE] = tokens - counts.sum()
    first = (counts + 0.5) / (tokens + 0.5 * symbols)
    rare_distinct = distinct - (ends > 0) - int(frequent.sum())
    rare_scale = float(np.log10(counts[RARE] + 0.5 * (rare_distinct + 1)))
    rare_head = head_counts[~frequent]
    others = (counts[RARE] - rare_head.sum() + 0.5 * (rare_distinct + 1 - len(rare_head))) / 10 ** rare_scale
    tree = Tree(tokens, distinct, head, head_counts, head_symbols, symbols, first, rare_scale, [], others)

    contexts = np.arange(symbols)
    for depth in range(DEPTH):
        tree.levels.append(Level(contexts, np.zeros(len(contexts)), np.zeros(0, np.int64), np.zeros(0, np.int64)))
        found = written(_counted(texts, _next_symbols(share(spark, tree))), "next-symbols")
        context = F.floor(F.col("code") / F.lit(symbols)).cast("long")
        sums = found.groupBy(context.alias("context")).agg(F.sum("n").alias("n")).collect()  # one row per context
        stored = _arrays(found.where(F.col("n") >= ENTRY * tokens).collect())  # 1 / ENTRY rows at most
        tree.levels[-1] = _level(contexts, _arrays(sums), stored, symbols)
        _prune(tree, depth)
        level = tree.levels[-1]
        longer = (level.counts >= SYMBOL * tokens) & (level.entries % symbols >= FIRST)
        contexts = level.entries[longer]
        if not len(contexts):
            break
    rare = words.where(F.col("n") < least)
    return tree, rare


def _level(codes: np.ndarray, sums, stored, symbols: int) -> Level:
    order = np.argsort(stored[0])
    total = np.zeros(len(codes))
    total[sums[0]] = sums[1]
    level = Level(codes, total, stored[0][order], stored[1][order])
    np.subtract.at(level.rest, level.entries // symbols, level.counts)
    return level


def _prune(tree: Tree, depth: int) -> None:
    """Keep the contexts whose next symbols diverge from those of their suffix, and the suffixes of kept contexts.

    What is not stored counts as one symbol, which can only make the divergence smaller.
    """
    level = tree.levels[depth]
    if not len(level.entries):
        return
    context, symbol = np.divmod(level.entries, tree.symbols)
    chain = [context]
    for d in range(depth, 0, -1):
        chain.append(tree.suffix(d)[chain[-1]])
    shorter = tree.first[symbol]
    for d, contexts in zip(range(depth), reversed(chain[1:])):
        shorter = tree.chance(d, contexts, symbol, shorter)
    p = level.counts / level.total[context]
    size = len(level.codes)
    divergence = np.bincount(context, p * np.log(p / shorter), size)
    p_rest = level.rest / np.maximum(level.total, 1)
    q_rest = np.maximum(1 - np.bincount(context, shorter, size), 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        divergence += np.where(p_rest > 0, p_rest * np.log(p_rest / q_rest), 0)
    level.kept = (divergence >= DIVERGENCE) & (level.total > 0)
    contexts = np.flatnonzero(level.kept)
    for d in range(depth, 0, -1):
        contexts = tree.suffix(d)[contexts]
        tree.levels[d - 1].kept[contexts] = True


def _words_before(numbers: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The last word before every token, the one before that, up to DEPTH; RARE from where a text starts or a word has no number."""
    out: list[np.ndarray] = []
    for depth in range(1, DEPTH + 1):
        word = np.full(len(numbers), RARE)
        word[depth:] = numbers[:-depth]
        word[place < depth] = RARE
        if out:
            word[out[-1] == RARE] = RARE
        out.append(word)
    return out


def _for_tail(tree: Tree, numbers: np.ndarray, seen: np.ndarray, place: np.ndarray, shards: int):
    """Which tokens have a context below the head tree, that context as one number (last word first), and its shard."""
    before = _words_before(numbers, place)
    in_head = sum((state >= 0).astype(np.int64) for state in tree.states(seen, place))
    code, root = np.zeros(len(numbers), np.uint64), np.zeros(len(numbers), np.uint64)
    below = np.zeros(len(numbers), bool)
    for depth, word in enumerate(before, 1):
        code |= word.astype(np.uint64) << np.uint64(BITS * (DEPTH - depth))
        starts = in_head == depth - 1
        root[starts] = code[starts]
        below |= starts & (word != RARE)
    at = np.flatnonzero(below)
    return at, code[at], (mix(root[at]) % np.uint64(shards)).astype(np.int64)


def _packed(code: np.ndarray, word: np.ndarray, row: np.ndarray, train: np.ndarray) -> bytes:
    """Tokens as bytes: codes sorted and as differences, and the bytes of equal weight side by side."""
    order = np.argsort(code, kind="stable")
    columns = [np.diff(code[order], prepend=np.uint64(0)), word[order].astype("<u4"), (row[order] << 1 | train[order]).astype("<u4")]
    raw = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 16
    column = lambda at, width, kind: np.ascontiguousarray(raw[at * n:(at + width) * n].reshape(width, n).T).view(kind).ravel()
    marked = column(12, 4, "<u4").astype(np.int64)
    return np.cumsum(column(0, 8, "<u8"), dtype=np.uint64), column(8, 4, "<u4").astype(np.int64), marked >> 1, marked & 1


def refine(tree: Tree, code: np.ndarray, word: np.ndarray, train: np.ndarray) -> np.ndarray:
    """What the tail adds to the log10 of each token's chance.  The tokens hold all of the subtrees they belong to."""
    order = np.lexsort((word, code))
    sorted_code, sorted_word = code[order], word[order]
    fresh = np.ones(len(order), bool)  # one row per context and next word
    fresh[1:] = (sorted_code[1:] != sorted_code[:-1]) | (sorted_word[1:] != sorted_word[:-1])
    pair = np.cumsum(fresh) - 1
    count = np.bincount(pair, train[order])
    code, word = sorted_code[fresh], sorted_word[fresh]

    symbol_of, share_of = tree.classes()
    number = [(code >> np.uint64(BITS * (DEPTH - d)) & np.uint64((1 << BITS) - 1)).astype(np.int64) for d in range(1, DEPTH + 1)]
    before = [symbol_of[n] for n in number]

    def head_context(depth: int, back: int) -> np.ndarray:
        if depth == 0:
            return np.where(before[back] >= FIRST, before[back], -1)
        shorter = head_context(depth - 1, back + 1)
        return _find(tree.levels[depth].codes, np.where((shorter >= 0) & (before[back] >= FIRST), shorter * tree.symbols + before[back], -1))

    symbol, in_head = symbol_of[word], np.zeros(len(code), np.int64)
    base = tree.first[symbol]
    for depth in range(len(tree.levels)):
        context = head_context(depth, 0)
        in_head += context >= 0
        base = tree.chance(depth, context, symbol, base)
    base = base * share_of[word]

    levels = []
    p = base
    for depth in range(1, DEPTH + 1):
        prefix = code >> np.uint64(BITS * (DEPTH - depth))
        fresh = np.ones(len(code), bool)
        fresh[1:] = prefix[1:] != prefix[:-1]
        group = np.cumsum(fresh) - 1
        entry = np.unique(group << BITS | word, return_inverse=True)[1]
        n, total = np.bincount(entry, count)[entry], np.bincount(group, count)
        own = ((number[depth - 1] != RARE) & (depth > in_head))[fresh]
        ratio = (np.maximum(n - 1, 0) / p + PRIOR) / (np.maximum(total, 1)[group] - 1 + PRIOR)
        gain = np.bincount(group, count * np.log(ratio))
        kept = own & (total >= LEAST) & (gain >= GAIN)
        p = np.where(kept[group], (n + PRIOR * p) / (total[group] + PRIOR), p)
        levels.append((group, n, total, own, kept))
    for shorter, longer in zip(levels[-2::-1], levels[:0:-1]):
        shorter[4][:] |= shorter[3] & (np.bincount(shorter[0], longer[4][longer[0]]) > 0)
    p = base
    for group, n, total, _, kept in levels:
        p = np.where(kept[group], (n + PRIOR * p) / (total[group] + PRIOR), p)
    out = np.empty(len(order))
    out[order] = np.log10(p / base)[pair]
    return out


def _sums(parts: pa.Table) -> pa.Table:
    """One sum per text from what the shards return for the texts that a task held together, at most some HELD_TOKENS tokens."""
    place = pc.list_flatten(parts["rows"]).to_numpy()
    total = np.bincount(place, pc.list_flatten(parts["deltas"]).to_numpy()) if len(place) else np.zeros(0)
    at = np.flatnonzero(total)
    return pa.table({"row": pa.array(at + parts["row"][0].as_py(), pa.int64()), "tail": pa.array(total[at], pa.float64())})


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    tree, rare = learn(rows.where(fold(F.col("doc_id")) != HELD_OUT).select("text"))
    model = share(spark, tree)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shards = 1 + int(tree.tokens / SHARD)
    train = fold(F.col("doc_id")) != HELD_OUT
    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", train.alias("train"))
    fields = f"doc_id {id_type}, row long, n_tokens long, n_known long, logs double, own double, words array<long>, times array<int>"
    sent = to_arrow_schema(_parse_datatype_string(f"{fields}, shard int, tail binary"))
    scored_fields = to_arrow_schema(_parse_datatype_string(f"{fields}, rows array<int>, deltas array<float>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hasher = shared(model), WordHasher()
        end_count = tree.first[END] * (tree.tokens + 0.5 * tree.symbols)  # its training count and 0.5
        waiting: list[tuple] = []

        def tails() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            code, shard, word, row, train = (np.concatenate(c) for c in zip(*waiting))
            waiting.clear()
            first = int(row.min()) if len(row) else 0
            order = np.argsort(shard, kind="stable")
            starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
            for mine in np.split(order, starts[1:]) if len(order) else ():
                blob = _packed(code[mine], word[mine], row[mine] - first, train[mine])
                values = {"row": first, "shard": int(shard[mine[0]]), "tail": blob}
                yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in sent], schema=sent)

        for batch in batches:
            row_ids, trains = batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, hashes, bounds in hasher.column(batch.column(2)):
                symbols, counts = tree.look_up(hashes)
                seen, place, starts = _with_ends(symbols, bounds)
                numbers = np.insert(tree.numbers(hashes), bounds[1:], END)
                below, code, shard = _for_tail(tree, numbers, seen, place, shards)
                of = at + np.searchsorted(starts, below, "right") - 1
                waiting.append((code, shard, numbers[below], row_ids[of], trains[of]))
                if sum(len(w[0]) for w in waiting) >= HELD_TOKENS:
                    yield from tails()
                own = np.log10(tree.chances(seen, place))
                logs = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 0.5), 0.0)
                # a head word of the rare class has its share of the class
                shares = np.where((symbols == RARE) & (counts >= 0), logs - tree.rare_scale, 0.0)
                rest = np.flatnonzero(counts < 0)
                texts = np.searchsorted(bounds, rest, "right") - 1
                words, number = [], []
                for i in range(len(bounds) - 1):
                    mine = rest[np.searchsorted(texts, i):np.searchsorted(texts, i, "right")]
                    w, n = np.unique(hashes[mine].view(np.int64), return_counts=True)
                    words.append(w)
                    number.append(n.astype(np.int32))
                tokens = np.diff(bounds) + 1
                total = lambda values: np.diff(np.concatenate([[0.0], np.cumsum(values)])[bounds])
                known = np.diff(np.concatenate([[0], np.cumsum(counts >= 0)])[bounds]) + (end_count > 0.6)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(tokens)), batch.column(1).slice(at, len(tokens)), pa.array(tokens),
                     pa.array(known), pa.array(total(logs) + np.log10(end_count)),
                     pa.array(np.add.reduceat(own, starts) + total(shares)),
                     pa.array(words, pa.list_(pa.int64())), pa.array(number, pa.list_(pa.int32())),
                     pa.array(row_ids[at:at + len(tokens)] % shards, pa.int32()), pa.nulls(len(tokens), pa.binary())], schema=sent)
        yield from tails()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard, waiting = shared(model), -1, []

        def sums() -> Iterator[pa.RecordBatch]:
            parts = [(*_unpacked(blob), first) for first, blob in waiting]
            waiting.clear()
            if not parts:
                return
            code, word, row, train = (np.concatenate([p[i] for p in parts]) for i in range(4))
            delta, at = refine(tree, code, word, train), 0
            for part_code, _, row, _, first in parts:
                mine = delta[at:at + len(part_code)]
                at += len(part_code)
                total = np.bincount(row, mine)
                rows = np.flatnonzero(total)
                values = {"row": first, "rows": rows.astype(np.int32), "deltas": total[rows].astype(np.float32)}
                yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in scored_fields], schema=scored_fields)

        for batch in batches:
            texts = batch.filter(pc.is_null(batch.column("tail")))
            empty = [pa.nulls(len(texts), f.type) for f in list(scored_fields)[-2:]]
            yield pa.RecordBatch.from_arrays([*texts.columns[:-2], *empty], schema=scored_fields)
            dealt = batch.filter(pc.is_valid(batch.column("tail")))
            for first, of, blob in zip(*(dealt.column(c).to_pylist() for c in ("row", "shard", "tail"))):
                if of != shard:
                    yield from sums()
                    shard = of
                waiting.append((first, blob))
        yield from sums()

    dealt = numbered.mapInArrow(run, f"{fields}, shard int, tail binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    both = written(dealt.mapInArrow(build, f"{fields}, rows array<int>, deltas array<float>"), "scored")
    scored = both.where(F.col("rows").isNull()).drop("rows", "deltas")
    asked = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    met = asked.join(rare.withColumnRenamed("code", "words"), "words", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    below = both.where(F.col("rows").isNotNull()).select("row", "rows", "deltas").groupBy("row").applyInArrow(_sums, "row long, tail double")
    none = F.lit(0).cast("long")
    added = met.select(
        "row", (F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"), F.col("times").cast("long").alias("rare_tokens"),
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).cast("long").alias("rare_known"), F.lit(0.0).alias("tail")).unionByName(
        below.select("row", F.lit(0.0).alias("more"), none.alias("rare_tokens"), none.alias("rare_known"), "tail"))
    more = added.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "rare_tokens", "rare_known", "tail")])
    whole = float(np.log10(tree.tokens + 0.5 * (tree.distinct + 1)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = scored.drop("words", "times").join(more, "row", "left")
    return out.select(
        F.col("doc_id").alias(key), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("own") + zero("tail") + zero("more") - zero("rare_tokens") * F.lit(tree.rare_scale)).alias("score"))
