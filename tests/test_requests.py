"""Request-log rules, and every operator on cut keys against the same operator on whole keys."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import frames, sequences, skew
from tidewell.session import settings

S = sequences.SECOND


def test_limit_refuses_without_trace():
    hits = []
    assert [sequences.limit_step(hits, t * S, 3, 10 * S) for t in (0, 1, 2, 3, 10, 11, 12, 13)] == [
        True, True, True, False, False, True, True, True]


def test_two_levels():
    state = {}
    calls = [("a", 0), ("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5)]
    assert [sequences.two_level_step(state, b, t * S, 2, 3, 100 * S) for b, t in calls] == [
        "ok", "ok", "browser", "ok", "network", "network"]
    assert sequences.two_level_step(state, "b", 6 * S, 2, 3, 100 * S) == "browser"  # the refused call was charged to b


def test_hold_is_fixed_not_sliding():
    out, until = [], None
    for t in (0, 1000, 1799, 1800, 3500, 3600):
        hit, until = sequences.hold_step(until, t * S, 1800 * S)
        out.append(hit)
    assert out == [False, True, True, False, True, False]


def test_breaker():
    state, seen = {}, []
    for t, o in [(0, "failure"), (1, "failure"), (2, "failure"), (30, "ok"), (62, "failure"), (100, "ok"), (122, "ok"), (123, "trip")]:
        allowed = sequences.breaker_step(state, t * S, o, 3, 60 * S)
        seen.append((allowed, *sequences.breaker_status(state, t * S, 60 * S)))
    assert seen == [(True, "degraded", 0), (True, "degraded", 0), (True, "down", 60), (False, "down", 32), (True, "down", 60),
                    (False, "down", 22), (True, "ok", 0), (True, "down", 60)]


def test_escalation_steps():
    state = {}
    turns = [("r1", False), (None, False), ("r2", True), ("r3", True), (None, True), ("r4", False)] + [(None, False)] * 5 + [("r5", False)]
    assert [sequences.escalation_step(state, *t) for t in turns] == [
        ("ask", "r1"), ("retry", None), ("ticket", "r1"), ("ticket", "r3"), ("none", None), ("ask", "r4"),
        *[("retry", None)] * 5, ("ask", "r5")]


@pytest.fixture(scope="module")
def log(spark):
    """One key with two thirds of the rows, several small ones."""
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", rnd.randrange(0, 40_000) * S // 10, rnd.choice(["ok", "failure", "failure", "trip"]),
             rnd.randrange(12), rnd.choice([None, 1.5, 2.0, 7.25]), "r" if rnd.random() < 0.3 else None,
             "m" if rnd.random() < 0.2 else None) for i in range(900)]
    return spark.createDataFrame(
        rows, "id bigint, k string, at bigint, outcome string, item bigint, v double, reason string, mail string").cache()


CASES = {
    "limit": lambda df, n: sequences.rate_limit(df, ["k"], "at", "id", 3, 20, n),
    "two_level": lambda df, n: sequences.rate_limit_two_level(df, "k", "item", "at", "id", 2, 3, 20, n),
    "ttl": lambda df, n: sequences.ttl_reuse(df, ["k"], "at", "id", 30, n),
    "flight": lambda df, n: sequences.single_flight(df, ["k"], "at", "id", "item", n),
    "breaker": lambda df, n: sequences.circuit_state(df, ["k"], "at", "id", "outcome", n),
    "lru": lambda df, n: sequences.lru_hits(df, ["k"], "at", "id", "item", 5, n),
    "rolling": lambda df, n: frames.rolling_mean(df, ["k"], "at", "id", "v", 4, n),
    "escalation": lambda df, n: sequences.escalation_flow(df, ["k"], "id", "reason", "mail", n),
}


@pytest.mark.parametrize("name", CASES)
def test_cut_keys_give_the_same(log, name):
    whole = CASES[name](log, 1_000_000)
    parts = CASES[name](log, 120)
    columns = sorted(whole.columns)
    assert parts.count() == log.count()
    assert sorted(map(repr, whole.select(columns).collect())) == sorted(map(repr, parts.select(columns).collect()))


def test_intervals(spark, log):
    rows = [("a", 1, 3), ("a", 3, 5), ("a", 7, 8), ("a", 2, 2), ("b", 1, 10), ("b", 2, 3), ("b", 9, 12)]
    df = spark.createDataFrame(rows, "k string, s int, e int")
    out = sorted(tuple(r) for r in frames.merge_intervals(df, "k", "s", "e").collect())
    assert out == [("a", 1, 5, 3), ("a", 7, 8, 1), ("b", 1, 12, 3)]
    many = log.selectExpr("k", "at div 1000000 as s", "at div 1000000 + item as e")
    whole = sorted(tuple(r) for r in frames.merge_intervals(many, "k", "s", "e").collect())
    assert sorted(tuple(r) for r in frames.merge_intervals(many, "k", "s", "e", 100).collect()) == whole


def test_split_hot_cuts_by_size(log):
    cut, was_split = skew.split_hot(log, ["k"], "at", 100)
    sizes = {(r["k"], r["_part"]): r["count"] for r in cut.groupBy("k", "_part").count().collect()}
    assert was_split and max(sizes.values()) <= 200 and len([1 for k in sizes if k[0] == "hot"]) >= 5


def test_ties_are_cut_too(spark):
    rows = spark.range(2_000).selectExpr("'k' as k", "id % 2 as at", "id as tie")
    cut, _ = skew.split_hot(rows, ["k"], "at", 100, "tie")
    parts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "tie")).alias("a"), F.max(F.struct("at", "tie")).alias("b"))
    parts = parts.orderBy("_part").collect()
    assert max(r["n"] for r in parts) <= 200 and sum(r["n"] for r in parts) == 2_000
    assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:]))


@pytest.fixture(scope="module")
def dense(spark):
    """A key without any gap, one with many rows at one moment, a missing key and small ones."""
    rnd = random.Random(9)
    rows = [(i, "dense", i // 3 * S, rnd.choice([0, 1, 7, 40, 900])) for i in range(3_000)]
    rows += [(5_000 + i, None, rnd.randrange(500) * S, rnd.randrange(60)) for i in range(1_500)]
    rows += [(8_000 + i, "ties", (i // 700) * 30 * S, 20) for i in range(1_400)] + [(9_900 + i, f"s{i % 5}", i * S, 3) for i in range(50)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "id bigint, k string, at bigint, hold bigint").cache(), rows


@pytest.mark.parametrize("name", ["ttl", "flight", "limit", "light"])
def test_dense_keys_side_by_side(dense, name):
    df, rows = dense
    rule = {"ttl": sequences.hold_rule("at", "id", 25), "flight": sequences.hold_rule("at", "id", "hold", "shared"),
            "limit": sequences.limit_rule("at", "id", 5, 12), "light": sequences.limit_rule("at", "id", 60, 12)}[name]
    work = sequences.Work()
    got = sequences.sequential(df, ["k"], rule, 500, work).collect()
    column = got[0].__fields__[-1]
    want = {}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        frame = sequences.pd.DataFrame(mine, columns=["id", "k", "at", "hold"])
        want |= dict(zip(frame["id"], rule.run(None, frame)[0][column]))
    assert {r["id"]: r[column] for r in got} == want and len(got) == len(rows)
    if name in ("ttl", "flight"):
        assert work.rounds <= 5 and work.repeated == 0  # some 20 pieces, five binary digits
    elif name == "limit":  # over the limit without a break: a round a piece, but few repetitions
        assert work.rounds <= 25 and work.repeated <= 4 * 30
    else:
        assert work.rounds <= 3 + 3  # the key with many rows at one moment is over its limit


def test_one_moment_holds_over_many_pieces(spark):
    """An answer that lives over whole pieces, and one that ends exactly where a row comes."""
    rows = spark.range(1_000).selectExpr("id", "'k' as k", f"id * {S} as at", "case when id in (0, 500) then 450 else 1 end as hold")
    got = sequences.single_flight(rows, ["k"], "at", "id", "hold", 100).where("not shared").select("id")
    assert sorted(r["id"] for r in got.collect()) == [0, *range(450, 501), *range(950, 1_000)]


def test_order_statistics(spark):
    rnd = random.Random(1)
    data = [rnd.expovariate(1) * 10 ** rnd.randrange(6) for _ in range(3000)] + [5.0] * 2000
    df = spark.createDataFrame([(x,) for x in data], "v double")
    ranks = [0, 10, 2499, 2500, 4999]
    assert skew.order_statistics(df, "v", ranks, small=50) == [sorted(data)[r] for r in ranks]
    assert skew.quantile(df.limit(0), "v", 0.5) is None


def test_spread_join_on_hot_and_missing_keys(spark, log):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w int")
    gaps = log.withColumn("k", F.when(F.col("id") % 4 != 0, F.col("k")))
    got = skew.spread_join(gaps, dim, "k")
    assert set(got.columns) == {*gaps.columns, "w"}
    key = {"hot": 1, "k1": 2}
    assert all(r["w"] == key.get(r["k"]) for r in got.collect()) and got.count() == gaps.count()


def test_two_sum(spark):
    rows = [("a", 0, 2.0), ("a", 1, 7.0), ("a", 2, 11.0), ("b", 0, 3.0), ("b", 1, 3.0), ("c", 0, 1.0),
            ("d", 0, 4.0), ("d", 1, 4.0), ("d", 2, 5.0)]
    df = spark.createDataFrame(rows, "k string, p bigint, v double")
    assert sorted(tuple(r) for r in frames.two_sum(df, "k", "p", "v", 9.0).select("k", "i", "j").collect()) == [
        ("a", 0, 1), ("d", 1, 2)]
    assert [tuple(r) for r in frames.two_sum(df, "k", "p", "v", 6.0).select("k", "i", "j").collect()] == [("b", 0, 1)]


def test_train_test_split_is_exact(spark):
    df = spark.range(1003).withColumnRenamed("id", "r")
    out = frames.train_test_split(df, "r", 0.2, "s")
    assert out.where("is_test").count() == round(1003 * 0.2) and out.count() == 1003
    again = frames.train_test_split(df, "r", 0.2, "s")
    assert out.exceptAll(again).count() == 0


def test_error_kinds(spark):
    rows = [(401, None), (404, None), (429, None), (503, None), (418, None), (None, "ReadTimeout"), (None, "gaierror"), (None, "KeyError")]
    df = spark.createDataFrame(rows, "status int, name string")
    out = [r[0] for r in df.select(sequences.classify_error(F.col("status"), F.col("name"))).collect()]
    assert out == ["auth", "model", "transient", "transient", "other", "transient", "network", "other"]


@pytest.mark.parametrize("small", [20_000, 50])
def test_order_statistics_of_odd_numbers(spark, small):
    """Infinities, NaN, nulls and one value that fills half the column."""
    import math

    rnd = random.Random(3)
    values = [rnd.gauss(0, 1e9) for _ in range(9_000)] + [7.5] * 12_000 + [math.inf] * 60 + [-math.inf] * 40 + [1e-300, 1e300]
    table = spark.createDataFrame([(v,) for v in values + [math.nan] * 30 + [None] * 20], "v double")
    want = sorted(values)
    ranks = [0, 39, 40, 41, 4_000, 9_000, 12_345, len(want) - 61, len(want) - 1, len(want), len(want) + 29]
    got = skew.order_statistics(table, "v", ranks, small)
    assert got[:-2] == [want[r] for r in ranks[:-2]] and all(math.isnan(x) for x in got[-2:])
    whole = spark.range(30_000).selectExpr("id % 100 as v")
    assert skew.order_statistics(whole, "v", [0, 15_000, 29_999], small) == [0, 50, 99]
    assert skew.quantiles(whole, "v", [0.5, 0.75], 30_000) == [49.5, 74.25]
    assert skew.quantile(table.where("v is null"), "v", 0.5) is None


def test_many_short_keys_share_batches(spark):
    """Keys cost a slice of a batch; one that ends in the next batch goes on from its state, and whole numbers stay whole beside nulls."""
    large = (1 << 53) + 1
    rows = [(k if k else None, t * 1_000_000, 10 * k + t, large + t if t % 2 else None) for k in range(40) for t in range(k % 7 + 1)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, id bigint, other bigint")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="3"):
        out = sequences.rate_limit(df, ["k"], "at", "id", 2, 3)
        found = sorted(out.collect(), key=lambda r: (r["k"] or 0, r["at"]))
    want = []
    for k in range(40):
        hits: list[int] = []
        want += [sequences.limit_step(hits, t * 1_000_000, 2, 3_000_000) for t in range(k % 7 + 1)]
    assert [(r["k"], r["at"], r["id"], r["other"]) for r in found] == rows
    assert [r["allowed"] for r in found] == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
