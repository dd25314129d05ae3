"""Prefix trie of conversations: every distinct sequence of first turns is a node.

1. **Order.** Turns shrink to a SHA-256 of role and text and a number of words, and are sorted by (conversation, turn) over the whole
   table.  A task's share of the sorted rows is a piece; a conversation of any length is a few pieces, so none meets in one task.
2. **Prefix digests.** A turn's place and digest give two 64-bit numbers; the XOR of those of the first turns is the digest
   of the prefix.  It is summed inside pieces and carried over them, so long conversations need no chain of steps.
3. **Nodes.** Rows are grouped by (depth, digest).  All rows of a node must have one last turn and one parent: by induction no
   two different prefixes then share a digest.  Otherwise everything is done again under another seed.
4. **Subtrees.** Leaves and saved words of a node are charged to its smallest member only.  Shards of bounded size hold whole paths
   of such members.  A shard numbers its distinct prefixes without gaps by a minimal perfect hash, every slot verified against the key
   it was made for; counts are scattered into flat arrays and added up through the array of parent slots, deepest first.  Sums of the
   shards are added by node.  Where a path is cut, what lies below the cut is added to the last node above it.

Defined results: turns are ordered by (turn, digest), null turns first; null role or text is empty; rows without a conversation
are left out; repeated rows are turns of their own; other columns play no part; an empty table gives no node.  The ids
that end in one node are hashed as one sorted stream (SHA-256 has no other way), in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.words import mix
from tidewell.operators.skew import lookup_join
from tidewell.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 20  # a rebuilt conversation begins like the first one of its block
HEADS = 4  # and takes 0 to HEADS - 1 turns from it
SHARD_ROWS = 200_000
SEED = 11
NODE = ["depth", "d1", "d2"]


# -- order ---------------------------------------------------------------------------------------------------------------------


def ordered_turns(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``piece``, ``at`` (place inside the piece, from 1), ``turn`` (digest) and ``words`` of every turn."""
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = table.select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("_turn"),
        F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256)).alias("turn"),
        F.regexp_count(what, F.lit(WORD)).cast("bigint").alias("words")).where("conv is not null")
    order = [F.col("conv"), F.asc_nulls_first("_turn"), F.col("turn"), F.col("_row")]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # cuts equal rows too
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            new = np.ones(len(ids), bool)
            new[1:] = ids[1:] != ids[:-1]
            goes_on = last is not None and ids[0] == last
            starts = np.flatnonzero(new)
            places = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
            if goes_on:
                places[:starts[1] if len(starts) > 1 else len(ids)] += at
            last, at = ids[-1], int(places[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), piece)), pa.array(places), batch.column(1), batch.column(2)],
                ["conv", "piece", "at", "turn", "words"])

    return materialise(rows.mapInArrow(number, "conv long, piece long, at long, turn binary, words long"), "turns")


def piece_places(turns: DataFrame) -> DataFrame:
    """Per conversation and piece: ``before`` (turns in earlier pieces), ``total`` and ``first`` (the first piece)."""
    sizes = turns.groupBy("conv", "piece").agg(F.max("at").alias("n"))
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "conv", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"),
        F.min("piece").over(whole).alias("first"))
    return materialise(sizes, "pieces")


def as_they_are(turns: DataFrame) -> DataFrame:
    """Rows of conversations for ``prefix_trie``: ``conv``, ``piece``, ``depth``, ``turn``, ``words``, ``length``, roots included."""
    places = piece_places(turns)
    rows = turns.join(places, ["conv", "piece"]).select(
        "conv", "piece", (F.col("before") + F.col("at")).alias("depth"), "turn", "words", F.col("total").alias("length"))
    return rows.unionByName(_roots(places.where("piece = first"), F.col("total"), F.col("first")))


def _roots(convs: DataFrame, length: Column, piece: Column) -> DataFrame:
    return convs.select("conv", piece.alias("piece"), F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("turn"),
                        F.lit(0).cast("bigint").alias("words"), length.alias("length"))


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """Rows as from ``as_they_are``, each conversation c rebuilt.

    It has the first h turns of conversation c - c % ``block`` (fewer if that has fewer) and its own turns after its
    first h, h = crc32(c) % ``heads``.
    """
    places = piece_places(turns)
    lead = turns.where((F.col("conv") % block == 0) & (F.col("at") < heads)).join(places, ["conv", "piece"])
    lead = lead.withColumn("depth", F.col("before") + F.col("at")).where(F.col("depth") < heads)
    lead = lead.groupBy(F.col("conv").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "words"))).alias("lead"))
    convs = places.where("piece = first").select(
        "conv", "total", "first", F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(heads)).alias("h"),
        (F.col("conv") - F.col("conv") % block).alias("_base")).join(lead, "_base", "left")
    convs = convs.withColumn("lead", F.slice(F.coalesce("lead", F.array()), 1, F.col("h").cast("int")))
    convs = convs.withColumn("shift", F.size("lead").cast("bigint") - F.col("h"))
    length = F.size("lead") + F.greatest(F.lit(0), F.col("total") - F.col("h"))
    convs = materialise(convs.select("conv", "first", "h", "shift", "lead", length.cast("bigint").alias("length")), "rebuilt")
    own = turns.join(places.join(convs.drop("lead", "first"), "conv"), ["conv", "piece"])
    own = own.withColumn("at", F.col("before") + F.col("at")).where("at > h").select(
        "conv", "piece", (F.col("at") + F.col("shift")).alias("depth"), "turn", "words", "length")
    taken = convs.select("conv", F.col("first").alias("piece"), F.explode("lead").alias("t"), "length").select(
        "conv", "piece", "t.depth", "t.turn", "t.words", "length")
    return own.unionByName(taken).unionByName(_roots(convs, F.col("length"), F.col("first")))


# -- nodes ---------------------------------------------------------------------------------------------------------------------


def _paths(rows: DataFrame, seed: int) -> DataFrame:
    """Add the digests of each prefix (``d1``, ``d2``) and of its parent (``p1``, ``p2``; null for the root)."""
    for i in (1, 2):
        z = F.when(F.col("depth") > 0, F.xxhash64(F.lit(2 * seed + i), "depth", "turn")).otherwise(F.lit(0))
        rows = rows.withColumn(f"z{i}", z.cast("bigint"))
    sums = rows.groupBy("conv", "piece").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv", "piece", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    for i in (1, 2):
        rows = rows.withColumn(f"l{i}", F.bit_xor(f"z{i}").over(upto))
    rows = rows.join(carry, ["conv", "piece"])
    digests = [F.col(f"l{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"d{i}") for i in (1, 2)]
    parents = [F.when(F.col("depth") > 0, F.col(f"l{i}").bitwiseXOR(F.col(f"c{i}")).bitwiseXOR(F.col(f"z{i}"))).alias(f"p{i}") for i in (1, 2)]
    return rows.select("conv", "piece", "depth", *digests, *parents, "turn", "words", (F.col("depth") == F.col("length")).alias("ends"))


def _nodes(paths: DataFrame) -> DataFrame:
    same = [F.min(c).eqNullSafe(F.max(c)) for c in ("turn", "p1", "p2")]
    return paths.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), (same[0] & same[1] & same[2]).alias("one"))


def nodes_of(rows: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Paths and nodes under the first seed for which no two prefixes share a digest."""
    while True:
        paths = materialise(_paths(rows, seed), "paths")
        nodes = materialise(_nodes(paths), "nodes")
        if nodes.where(~F.col("one")).isEmpty():
            break
        seed += 1
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.drop("one").join(children, NODE, "left").fillna({"n_children": 0})
    return paths, materialise(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")


# -- subtrees ------------------------------------------------------------------------------------------------------------------


class SlotTable:
    """A minimal perfect hash: distinct 64-bit keys to 0 ... n - 1.

    A level gives every key left a cell of a bit field twice their number; keys alone in their cell keep it, the others go on to
    the next level.  A key's slot is the number of kept cells before its own.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # kept cells, and how many slots there are before each
        self.size, level = 0, 0
        while len(keys):
            cells = self._cells(keys, level, 2 * len(keys) + 1)
            counts = np.bincount(cells, minlength=2 * len(keys) + 1)
            kept = counts == 1
            self.levels.append((kept, self.size + np.cumsum(kept) - kept))
            self.size += int(kept.sum())
            keys, level = keys[~kept[cells]], level + 1

    @staticmethod
    def _cells(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        salted = mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return (salted % np.uint64(cells)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key; any slot, or -1, for a key that the table was not made for."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (kept, before) in enumerate(self.levels):
            cells = self._cells(keys[left], level, len(kept))
            here = kept[cells]
            out[left[here]] = before[cells[here]]
            left = left[~here]
        return out


def _keys(columns: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(columns[0]), np.uint64(salt))
    for c in columns:
        out = mix(out ^ c.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return out


def add_up(start: np.ndarray, depth: np.ndarray, d1: np.ndarray, d2: np.ndarray, p1: np.ndarray, p2: np.ndarray,
           values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One shard: the first row of each distinct prefix, and the sums of ``values`` over the prefix and all below it.

    ``start`` is the depth at which the row's piece begins; prefixes of pieces that begin elsewhere are apart, and the
    first of a piece has no parent here.
    """
    own, parent = [start, depth, d1, d2], [start, depth - 1, p1, p2]
    salt = 0
    while True:
        keys = _keys(own, salt)
        distinct, first = np.unique(keys, return_index=True)
        table = SlotTable(distinct)
        slots = table.slots(keys)
        at = np.empty(table.size, np.int64)  # slot to the row it was made for
        at[table.slots(distinct)] = first
        if all((c[at[slots]] == c).all() for c in own):  # every row has met its own key
            break
        salt += 1
    flat = [np.zeros(table.size, np.int64) for _ in values]
    for total, v in zip(flat, values):
        np.add.at(total, slots, v)
    up = np.full(table.size, -1, np.int64)
    inner = np.flatnonzero(depth[at] > start[at])
    up[inner] = table.slots(_keys([c[at[inner]] for c in parent], salt))
    if not all((o[at[up[inner]]] == p[at[inner]]).all() for o, p in zip(own, parent)):
        raise ValueError("a path lacks one of its prefixes")
    order = np.argsort(-depth[at], kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(depth[at][order], prepend=-1)), len(order))
    for low, high in zip(bounds[:-1], bounds[1:]):
        level = order[low:high]
        level = level[up[level] >= 0]
        for total in flat:
            np.add.at(total, up[level], total[level])
    return at, flat


def subtree_sums(paths: DataFrame, nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``depth``, ``d1``, ``d2``, ``n_leaves`` and ``saved_tokens`` of every node."""
    charged = nodes.select(*NODE, F.col("conv_id").alias("conv"), (F.col("n_children") == 0).cast("bigint").alias("leaf"), "saved",
                           F.lit(1).alias("owned"))
    rows = paths.select("conv", "piece", *NODE, "p1", "p2").join(charged, [*NODE, "conv"], "left")
    rows = materialise(rows.fillna({"leaf": 0, "saved": 0, "owned": 0}), "charged")
    pieces = rows.groupBy("conv", "piece").agg(
        F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.sum("owned").alias("owned"), F.min("depth").alias("start"),
        F.max("depth").alias("end"), F.max(F.when(F.col("depth") == 1, F.col("d1"))).alias("lead"))
    whole = Window.partitionBy("conv")
    later = whole.orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    pieces = pieces.select(
        "conv", "piece", "start", "end", F.max("lead").over(whole).alias("lead"), F.sum("owned").over(whole).alias("owned"),
        F.coalesce(F.sum("leaf").over(later), F.lit(0)).alias("_leaf"), F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("_saved"))
    rows = rows.drop("owned").join(pieces.where("owned > 0").drop("owned"), ["conv", "piece"])
    last = F.col("depth") == F.col("end")
    for c in ("leaf", "saved"):
        rows = rows.withColumn(c, F.col(c) + F.when(last, F.col(f"_{c}")).otherwise(0))
    numbers = ["conv", "piece", "start", *NODE, "p1", "p2", "leaf", "saved"]
    # conversations with the same first turn are neighbours; none is too large for a shard but by a single piece
    rows = rows.select("lead", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers])
    rows = rows.repartitionByRange("lead", "conv", "piece").sortWithinPartitions("lead", "conv", "piece", "depth").drop("lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(parts: list[np.ndarray]) -> pa.RecordBatch:
            _, _, start, depth, d1, d2, p1, p2, leaf, saved = np.concatenate(parts, axis=1)
            at, (leaves, words) = add_up(start, depth, d1, d2, p1, p2, [leaf, saved])
            columns = [depth[at], d1[at], d2[at], leaves, words]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*NODE, "leaves", "words"])

        held: list[np.ndarray] = []
        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held.append(part)
            if sum(p.shape[1] for p in held) >= shard_rows:
                both = np.concatenate(held, axis=1)
                edge = np.flatnonzero((both[0, 1:] != both[0, :-1]) | (both[1, 1:] != both[1, :-1]))
                if len(edge):
                    cut = int(edge[-1]) + 1
                    yield shard([both[:, :cut]])
                    both = both[:, cut:].copy()
                held = [both]
        if held and sum(p.shape[1] for p in held):
            yield shard(held)

    sums = rows.mapInArrow(run, "depth long, d1 long, d2 long, leaves long, words long")
    return sums.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("words").alias("saved_tokens"))


def end_digests(paths: DataFrame) -> DataFrame:
    """SHA-256 of the sorted ids of the conversations that end in each node, as one stream per task."""
    rows = paths.where("ends").select(*NODE, "conv").repartition(*NODE).sortWithinPartitions(*NODE, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.string(),))], [*NODE, "ends_sha256"])

        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]])
            ids = batch.column(3).to_pylist()
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(ids) else []
            for low, high in zip(starts, [*starts[1:], len(ids)]):
                joined = ",".join(map(str, ids[low:high])).encode()
                if (here := tuple(keys[:, low].tolist())) != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = here, hashlib.sha256(joined)
                else:
                    digest.update(b"," + joined)
            if len(out) >= 2_000:
                yield pack()
                out.clear()
        if node is not None:
            out.append((*node, digest.hexdigest()))
        if out:
            yield pack()

    return rows.mapInArrow(run, "depth long, d1 long, d2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """One row per node of the trie over ``rows`` (of ``as_they_are`` or ``rebuilt``)."""
    paths, nodes = nodes_of(rows, seed)
    sums, ends = subtree_sums(paths, nodes, shard_rows), end_digests(paths)
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children").join(sums, NODE).join(ends, NODE, "left")
    out = out.fillna({"ends_sha256": none}).withColumn("_up", F.col("depth") - 1)
    up = nodes.where("n_children > 0").select(
        F.col("depth").alias("_up"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    out = lookup_join(out, up.withColumnRenamed("n_children", "_children"), ["_up", "p1", "p2"], "_children")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def report(table: DataFrame, **more) -> DataFrame:
    """The trie of the rebuilt conversations of ``table``."""
    return prefix_trie(rebuilt(ordered_turns(table, **more)))


def oracle() -> str:
    """Prefixes as digests of whole sequences; subtree sums by pairs of prefixes on the same path."""
    bits = "list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])::bigint), lambda a, b: {bits}), 4294967295)"
    return f"""
        with t as (
            select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as i,
                coalesce(role, '') as role, coalesce(text, '') as text
            from conversations where conv_id is not null),
        ids as (select distinct c, c::varchar as t from t),
        heads as (select c, c - c % {BLOCK} as base, {crc} % {HEADS} as h from ids),
        taken as (select h.c, t.i as pos, role, text from heads h join t on t.c = h.base and t.i <= h.h),
        counts as (select h.c, h.h, count(k.pos) as n from heads h left join taken k on k.c = h.c group by all),
        own as (select n.c, t.i - n.h + n.n as pos, role, text from counts n join t on t.c = n.c and t.i > n.h),
        turns as (select * from taken union all select * from own),
        chained as (
            select c, pos, len(regexp_extract_all(text, '{WORD}')) as words,
                sha256(string_agg(length(role)::varchar || ':' || role || length(text)::varchar || ':' || text, '' order by pos)
                    over (partition by c order by pos)) as node
            from turns),
        path as (
            select c, pos, words, node, max(pos) over (partition by c) as last from chained
            union all select h.c, 0, 0, '', coalesce((select max(pos) from turns where turns.c = h.c), 0) from heads h),
        nodes as (
            select node, pos as depth, min(c) as conv_id, count(*) as n_convs, max(words) as words,
                sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where pos = last), '')) as ends_sha256
            from path group by node, pos),
        links as (select distinct a.node as child, b.node as parent from path a join path b on a.c = b.c and a.pos = b.pos + 1),
        sizes as (select n.node, count(l.child) as n_children from nodes n left join links l on l.parent = n.node group by 1),
        pairs as (select distinct a.node as top, b.node as below from path a join path b on a.c = b.c and a.pos <= b.pos),
        sums as (
            select top as node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * words) as saved
            from pairs join nodes on nodes.node = below join sizes on sizes.node = below group by 1)
        select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, s.n_children,
            m.n_leaves::bigint as n_leaves, m.saved::bigint as saved_tokens, n.ends_sha256
        from nodes n join sizes s using (node) join sums m using (node)
        left join links l on l.child = n.node left join nodes p on p.node = l.parent"""
