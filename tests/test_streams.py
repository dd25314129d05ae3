"""Streams over folders in several batches against the batch operators, late rows, state that goes, restart."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewell.operators import sequences
from tidewell.sources.keyed import KeyedTable
from tidewell.streaming import jobs
from tidewell.streaming.processors import stateful

S = sequences.SECOND
START = 1_700_000_000 * S


def write_files(spark, folder, rows, groups):
    """One part file per group of ids, in this order, so that one file a batch makes as many batches."""
    import os
    import time

    for i, ids in enumerate(groups):
        rows.where(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if os.path.getmtime(path) > time.time() - 1000:  # the source takes files by age
                os.utime(path, (time.time() - 5000 + i * 10,) * 2)
    return folder


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """300 calls; eight files of neighbours with their rows mixed across up to 24 places."""
    rows = spark.range(0, 300, 1, 1).selectExpr(
        "id", "concat('k', id % 3) as k", f"{START} + id * {7 * S} + (id % 5) * {S} as at",
        "case when id % 4 = 0 then 'ok' else 'failure' end as outcome").withColumn("ts", F.timestamp_micros("at"))
    order = sorted(range(300), key=lambda i: i + random.Random(i).uniform(0, 24))
    root = tmp_path_factory.mktemp("calls")
    return str(root), rows, write_files(spark, str(root / "calls.parquet"), rows, [order[i * 38:(i + 1) * 38] for i in range(8)])


def rule_of(name):
    rule = {"limit": sequences.limit_rule("at", "id", 3, 60), "breaker": sequences.breaker_rule("at", "id", "outcome"),
            "hold": sequences.hold_rule("at", "id", 45)}[name]
    return rule, {"limit": 60, "breaker": None, "hold": 45}[name]


def same(got, want):
    columns = sorted(want.columns)
    return sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


@pytest.mark.parametrize("name", ["limit", "breaker", "hold"])
def test_rows_out_of_order(spark, calls, name):
    folder, rows, _ = calls
    rule, keep = rule_of(name)
    stream = jobs.file_stream(spark, folder, "calls.parquet", 1).withWatermark("ts", "5 minutes")
    run = jobs.run_rule(stream, ["k"], rule, "at", keep, name, 90)
    assert run.batches >= 8 and run.late == 0
    assert same(run.table, sequences.sequential(rows.drop("ts"), ["k"], rule))


def test_late_rows_are_counted(spark, calls, tmp_path):
    _, rows, _ = calls
    rule, keep = rule_of("limit")
    late = [3, 4, 50, 51, 52]
    groups = [[i for i in range(0, 150) if i not in late], range(150, 299), late, [299]]
    write_files(spark, str(tmp_path / "calls.parquet"), rows, [list(g) for g in groups])
    stream = jobs.file_stream(spark, str(tmp_path), "calls.parquet", 1).withWatermark("ts", "1 minute")
    run = jobs.run_rule(stream, ["k"], rule, "at", keep, "late", 20)
    assert run.late == len(late)
    assert same(run.table, sequences.sequential(rows.where(~F.col("id").isin(late)).drop("ts"), ["k"], rule))


def test_one_file_and_one_batch(spark, calls, tmp_path):
    _, rows, _ = calls
    rule, keep = rule_of("hold")
    rows.coalesce(1).write.parquet(str(tmp_path / "w"))
    import os

    part = next(n for n in os.listdir(tmp_path / "w") if n.startswith("part"))
    os.link(tmp_path / "w" / part, tmp_path / "one.parquet")
    stream = jobs.file_stream(spark, str(tmp_path), "one.parquet").withWatermark("ts", "1 minute")
    assert same(jobs.run_rule(stream, ["k"], rule, "at", keep, "one").table, sequences.sequential(rows.drop("ts"), ["k"], rule))


def test_empty_state_goes(spark, tmp_path):
    """Conversations in which nothing is pending leave no state."""
    rows = spark.range(50).selectExpr("id as conv_id", "1L as turn", "cast(null as string) as reason", "cast(null as string) as mail")
    rows = rows.unionAll(spark.sql("select 99L, 1L, 'asked for a person', cast(null as string)"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    stream = jobs.file_stream(spark, str(tmp_path), "t.parquet")
    run = jobs.run_stream(stateful(stream, ["conv_id"], sequences.escalation_rule("turn", "reason", "mail")), "flow")
    left = spark.read.format("statestore").option("stateVarName", "state").load(run.marks)
    assert [r[0] for r in left.select("key.conv_id").collect()] == [99] and run.table.count() == 51


def test_dialogue_in_any_pieces(spark, tmp_path):
    script = "Opening music\nMARA: Good evening.\nAnd welcome back.\nPIET: Evening!\n\nMARA: That is all"
    for size in (2, 19, 300):
        folder = tmp_path / f"s{size}"
        pieces = [("e", i, script[i * size:(i + 1) * size]) for i in range(-(-len(script) // size))]
        spark.createDataFrame(pieces, "k string, n bigint, piece string").coalesce(1).write.parquet(str(folder / "p.parquet"))
        stream = jobs.file_stream(spark, str(folder), "p.parquet").withColumn("at", F.lit(START) + F.col("n") * S)
        stream = stream.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", "1 minute")
        run = jobs.run_rule(stream, ["k"], jobs.dialogue_rule("n", "piece", ["mara", "piet"]), "at", None, "d", 30)
        done = jobs.released_turns(run.table, ["k"])
        turns = jobs.spoken(done.unionByName(jobs.open_turns(run.states, ["k"], ["mara", "piet"])), ["k"])
        said = [(r["speaker"], r["text"]) for r in turns.collect()]
        assert sorted(said) == [("mara", "Good evening. And welcome back."), ("mara", "That is all"), ("piet", "Evening!")]


def test_running_counts(spark, calls):
    folder, _, _ = calls
    stream = jobs.file_stream(spark, folder, "calls.parquet", 1)
    got = {r["k"]: r["count"] for r in jobs.running_counts(stream, "k", "counts", most=3).collect()}
    assert got == {"k0": 100, "k1": 100, "k2": 100}


def test_keyed_table(spark, tmp_path):
    """Changes and bases against a dictionary; few folders after many batches; a batch that comes again changes nothing."""
    import os

    sums, last = KeyedTable(spark, str(tmp_path / "sums"), ["k"], ["n"], most=4), KeyedTable(spark, str(tmp_path / "last"), ["k"], most=5)
    want, newest = {}, {}
    for number in range(14):
        rows = [(None if k == 0 else f"k{k}", k + number) for k in range(number % 3, 6)]
        batch = spark.createDataFrame(rows, "k string, n bigint").coalesce(1)
        for _ in range(1 + (number in (3, 5))):  # some come twice
            sums.merge(batch, number)
            last.merge(batch, number)
        for k, n in rows:
            want[k], newest[k] = want.get(k, 0) + n, n
    sums.merge(spark.createDataFrame([("k1", 1_000)], "k string, n bigint"), 2)  # long in a base
    assert {r.k: r.n for r in sums.read().collect()} == want and {r.k: r.n for r in last.read().collect()} == newest
    assert len(os.listdir(tmp_path / "sums")) <= 5 and len(os.listdir(tmp_path / "last")) <= 6
    os.remove(tmp_path / "sums" / f"base-{sums._folders()[0]}" / "_SUCCESS")  # half written
    assert sums._folders()[0] == -1


def test_a_key_waits_in_many_chunks(spark, tmp_path, monkeypatch):
    """Rows of one key are appended in chunks by bucket; no entry holds them all."""
    monkeypatch.setattr("tidewell.streaming.processors.CHUNK_ROWS", 100)
    rows = spark.range(0, 3_000, 1, 4).selectExpr("id", "'k' as k", f"{START} + id * {S} as at").withColumn("ts", F.timestamp_micros("at"))
    rows.write.parquet(str(tmp_path / "t.parquet"))
    rule = sequences.hold_rule("at", "id", 45)
    stream = jobs.file_stream(spark, str(tmp_path), "t.parquet", 1).withWatermark("ts", "1 day")
    run = jobs.run_rule(stream, ["k"], rule, "at", 45, "chunks", 600)
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(run.marks)
    longest = held.selectExpr("count(*) as n", "max(length(user_map_value.body)) as l").first()
    assert longest.n >= 30 and longest.l < 6_000
    assert same(run.table, sequences.sequential(rows.drop("ts"), ["k"], rule))


def test_small_buckets_share_entries(spark, tmp_path):
    """A key with a few rows an hour costs an entry and not one for every hour; two files bring hours in turn, and one ends what waits."""
    hours = [(i, f"k{i % 2}", START + (i // 2) * 3_600 * S) for i in range(120)]
    for name, part in (("a", hours[:40:2] + hours[1:80:3]), ("b", [h for h in hours if h not in hours[:40:2] + hours[1:80:3]])):
        rows = spark.createDataFrame(part, "id bigint, k string, at bigint").withColumn("ts", F.timestamp_micros("at")).coalesce(1)
        rows.write.mode("append").parquet(str(tmp_path / "t.parquet"))
    table = spark.read.parquet(str(tmp_path / "t.parquet")).drop("ts")
    rule = sequences.limit_rule("at", "id", 2, 3 * 3_600)
    for delay, most in (("10 days", 8), ("2 days", 8)):
        stream = jobs.file_stream(spark, str(tmp_path), "t.parquet", 1).withWatermark("ts", delay)
        run = jobs.run_rule(stream, ["k"], rule, "at", 3 * 3_600, "shared", 3_600)
        held = spark.read.format("statestore").option("stateVarName", "waiting").load(run.marks)
        assert 0 < held.count() <= most
        assert same(run.table, sequences.sequential(table, ["k"], rule))


@pytest.mark.parametrize("name", ["limit", "breaker", "hold"])
def test_many_keys_share_slots(spark, tmp_path, monkeypatch, name):
    """Spark is called for slots and not for keys; keys keep their own states, a null key too, and states go when their time is over."""
    monkeypatch.setattr("tidewell.streaming.processors.SLOTS", 3)
    rows = spark.range(0, 600, 1, 1).selectExpr(
        "id", "case when id % 37 > 0 then concat('k', id % 37) end as k", "cast(id % 2 as int) as part", f"{START} + id * {7 * S} as at",
        "case when id % 4 = 0 then 'ok' else 'failure' end as outcome").withColumn("ts", F.timestamp_micros("at"))
    folder = str(tmp_path / "calls.parquet")
    order = sorted(range(600), key=lambda i: i + random.Random(i).uniform(0, 24))
    write_files(spark, folder, rows, [order[i * 100:(i + 1) * 100] for i in range(6)])
    rule, keep = rule_of(name)
    stream = jobs.file_stream(spark, str(tmp_path), "calls.parquet", 1).withWatermark("ts", "5 minutes")
    run = jobs.run_rule(stream, ["k", "part"], rule, "at", keep, "slots", 90)
    assert same(run.table, sequences.sequential(rows.drop("ts"), ["k", "part"], rule))
    for variable in ("waiting", "counts"):
        held = spark.read.format("statestore").option("stateVarName", variable).load(run.marks)
        assert held.select("key").distinct().count() <= 3
    left = spark.read.format("statestore").option("stateVarName", "state").load(run.marks).select("user_map_value.last").collect()
    if keep is not None:  # nothing older than a state is kept for, the watermark's delay, and two buckets
        assert all(r["last"] > START + (599 * 7 - 300 - keep - 2 * 90 - 24 * 7) * S for r in left)
    states = run.states.collect()
    assert len({(r["k"], r["part"]) for r in states}) == len(states) <= 74


def test_restart_reads_only_new_files(spark, calls):
    from tidewell.session import work_dir

    folder, _, _ = calls
    marks, out = work_dir(spark, "restart"), work_dir(spark, "restart-out")
    stream = jobs.file_stream(spark, folder, "calls.parquet", 1).select("id")
    for _ in range(2):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(
            availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 300


@pytest.mark.parametrize("name", ["rate_limit_stream", "ttl_reuse_stream", "single_flight_stream", "rate_limit_two_level_stream",
                                  "circuit_state_stream", "escalation_stream", "dialogue_stream", "topic_counts_stream",
                                  "audit_stream", "event_feed"])
def test_queries_on_folders(spark, tmp_path_factory, monkeypatch, name):
    """Every stream query on folders of eight files, two a batch, gives what its batch twin gives on whole tables.

    Rows cross batches by less than the watermark's delay.
    """
    import duckdb

    from tidewell.plans.registry import ORACLES, QUERIES
    from tests.check_oracle import duck, rows_of

    monkeypatch.setattr(jobs, "FILES_PER_BATCH", 2)
    source = "/root/testdata/sf0.001"
    root = tmp_path_factory.mktemp("folders")
    late = {"events": "epoch_us(ts) + hash(event_id) % 500000000", "conversations": "conv_id * 60 + turn + hash(conv_id, turn) % 1000"}
    for t in ("events", "conversations"):
        folder = root / f"{t}.parquet"
        folder.mkdir()
        con = duckdb.connect()
        con.execute(f"create table t as select *, ntile(8) over (order by {late[t]}) as part from '{source}/{t}.parquet'")
        for i in range(1, 9):
            path = str(folder / f"part-{i}.parquet")
            con.execute(f"copy (select * exclude (part) from t where part = {i}) to '{path}' (format parquet)")
            os.utime(path, (time.time() - 5_000 + i * 10,) * 2)
    got = QUERIES[name](spark, str(root))
    con = duck(source)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())
