import hashlib
import zlib

import numpy as np
import pytest

from tidewell.llm import prefix_trie
from tidewell.llm.words import series
from tidewell.session import settings

COLUMNS = "conv_id long, turn long, role string, text string, depth string, piece long"


def words(text):
    return len((text or "").encode().split())


def rebuilt_plainly(rows, block=20, heads=4):
    turns = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()
            turns.setdefault(c, []).append(((t is not None, t or 0), digest, r or "", x or ""))
    plain = {c: [v[2:] for v in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in plain.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = plain.get(c - c % block, [])[:h] + ts[h:]
    return out


def trie_plainly(convs):
    """Every node by its whole sequence of turns."""
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    rows = set()
    for p, cs in members.items():
        below, stack = [], [p]
        while stack:
            q = stack.pop()
            below.append(q)
            stack += children.get(q, [])
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        rows.add((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])),
            sum(q not in children for q in below), sum((len(members[q]) - 1) * words(q[-1][1]) for q in below if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return rows


def frame(spark, rows, parts=3):
    rows = [(c, t, r, x, "own", 1) for c, t, r, x in rows]
    return spark.createDataFrame(rows, COLUMNS).repartition(parts)


ROWS = (
    [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c % 3} words") for c in range(0, 45) for t in range(c % 6)]
    + [(60, 0, "user", None), (60, 1, None, ""), (60, None, "user", "first of all"), (61, 5, "user", "alone")]
    + [(80, 0, "u", "same\ttext"), (80, 0, "u", "same\ttext"), (81, 0, "u", "same\ttext"), (81, 1, "u", "same\ttext")]
    + [(None, 0, "user", "nobody"), (7, 99, "user", "ä€😀 " * 50)]
)


def test_against_whole_sequences(spark):
    got = prefix_trie.report(frame(spark, ROWS)).collect()
    want = trie_plainly(rebuilt_plainly(ROWS))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_as_they_are_and_small_shards(spark):
    rows = frame(spark, ROWS)
    got = prefix_trie.prefix_trie(prefix_trie.as_they_are(prefix_trie.ordered_turns(rows)), shard_rows=7).collect()
    want = trie_plainly(rebuilt_plainly(ROWS, heads=1))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_one_conversation_over_many_pieces(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (20, 21, 23, 25) for t in range(300 if c < 25 else 5)]
    rows += [(21, None, "user", f"equal {i % 2}") for i in range(60)]
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        turns = prefix_trie.ordered_turns(frame(spark, rows, 8))
        assert turns.where("conv = 21").select("piece").distinct().count() > 1
        got = prefix_trie.prefix_trie(prefix_trie.rebuilt(turns), shard_rows=50).collect()
    want = trie_plainly(rebuilt_plainly(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_table_and_ids_only(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert prefix_trie.report(empty).collect() == []
    only = spark.createDataFrame([(None, 1, "a", "b", "", 0)], COLUMNS)
    assert prefix_trie.report(only).collect() == []


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 50_000])
def test_slots_are_perfect_and_minimal(count):
    keys = series(5, count)
    slots = prefix_trie.SlotTable(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(count))


def test_colliding_keys_get_another_salt(monkeypatch):
    real, salts = prefix_trie._keys, []

    def weak(columns, salt):
        salts.append(salt)
        return real(columns, salt) if salt else np.zeros(len(columns[0]), np.uint64)

    monkeypatch.setattr(prefix_trie, "_keys", weak)
    depth, start = np.array([0, 1, 2, 2]), np.zeros(4, np.int64)
    d, p = np.array([0, 5, 6, 7]), np.array([0, 0, 5, 5])
    at, (total,) = prefix_trie.add_up(start, depth, d, d, p, p, [np.array([0, 0, 1, 1])])
    assert max(salts) == 1 and dict(zip(depth[at].tolist(), total.tolist())) == {0: 2, 1: 2, 2: 1}


def test_colliding_digests_are_done_again(spark, monkeypatch):
    real, seeds = prefix_trie._paths, []

    def weak(rows, seed):
        seeds.append(seed)
        paths = real(rows, seed)
        if len(seeds) > 1:
            return paths
        from pyspark.sql import functions as F

        return paths.withColumns({c: F.when(F.col("depth") > 0, F.lit(1)).otherwise(F.col(c)).cast("long") for c in ("d1", "d2")})

    monkeypatch.setattr(prefix_trie, "_paths", weak)
    got = prefix_trie.report(frame(spark, ROWS)).collect()
    assert len(seeds) == 2 and {tuple(r) for r in got} == trie_plainly(rebuilt_plainly(ROWS))
