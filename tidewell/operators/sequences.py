"""Request-log rules that depend on earlier decisions: limits, reuse, circuit state, escalation, cache hits.

The step functions at the top decide one event from a small state.  The batch operators below and the streaming
processors in ``tidewell.streaming`` share them.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell import fixed
from tidewell.operators import skew
from tidewell.session import materialise

SECOND = 1_000_000


def limit_step(hits: list[int], now: int, limit: int, window: int) -> bool:
    """Accept unless ``limit`` accepted events lie within ``window``; refused events leave no trace."""
    del hits[: next((i for i, h in enumerate(hits) if now - h <= window), len(hits))]
    if len(hits) >= limit:
        return False
    hits.append(now)
    return True


def two_level_step(state: dict, browser: str, now: int, limit: int, network_limit: int, window: int) -> str:
    """'ok', 'browser' or 'network'.  The network is asked only when the browser may pass, and then both are charged."""
    browsers = state.setdefault("browsers", {})
    mine = browsers.setdefault(browser, [])
    if not limit_step(mine, now, limit, window):
        return "browser"
    for idle in [b for b, h in browsers.items() if not h or now - h[-1] > window]:
        del browsers[idle]
    return "ok" if limit_step(state.setdefault("network", []), now, network_limit, window) else "network"


def hold_step(expires: int | None, now: int, hold: int) -> tuple[bool, int]:
    """True while the stored answer lives; its life is fixed when it is stored."""
    if expires is not None and now < expires:
        return True, expires
    return False, now + hold


def breaker_step(state: dict, now: int, outcome: str, threshold: int, cooldown: int) -> bool:
    """Let a call through or not, then count its outcome ('ok', 'failure', 'trip').  ``state``: failures, opened."""
    opened = state.get("opened")
    if opened is not None and now - opened < cooldown:
        return False
    if outcome == "ok":
        state.update(failures=0, opened=None)
        return True
    state["failures"] = max(state.get("failures", 0) + (outcome == "failure"), threshold if outcome == "trip" else 0)
    if opened is not None or state["failures"] >= threshold:
        state["opened"] = now
    return True


def breaker_status(state: dict, now: int, cooldown: int) -> tuple[str, int]:
    opened = state.get("opened")
    if opened is None:
        return ("degraded" if state.get("failures") else "ok"), 0
    return "down", round(max(0, cooldown - (now - opened)) / SECOND)


HISTORY_TURNS = 6


def escalation_step(state: dict, reason: str | None, has_email: bool) -> tuple[str, str | None]:
    """(action, reason) of one user turn: 'ticket', 'ask', 'retry' or 'none'.

    A pending request is seen for as long as it lies within the last ``2 * HISTORY_TURNS`` history entries; each turn
    adds two entries after it.
    """
    pending, age = state.get("reason"), state.get("age", 0)
    if pending is not None and age < HISTORY_TURNS:
        if has_email:
            state.clear()
            return "ticket", pending
        state["age"] = age + 1
        return "retry", None
    state.clear()
    if reason is None:
        return "none", None
    if has_email:
        return "ticket", reason
    state.update(reason=reason, age=1)
    return "ask", reason


def no_rows(names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


# --- running a step function over a table --------------------------------------


@dataclass(frozen=True)
class Rule:
    """``run(state, rows) -> (new columns, state)`` over the ordered rows of one key, and the columns it adds.

    After a gap of more than ``quiet`` in the first order column the state is as good as empty.  A rule whose state is one moment,
    up to which every row is like the others, has ``until``: the moment that each row would set if it came after the last one.
    """

    run: Callable
    added: str
    order: tuple[str, ...]
    quiet: int | None = None
    until: Callable[[pd.DataFrame], np.ndarray] | None = None


@dataclass
class Work:
    """How much a run over cut keys took: ``rounds`` of joins or of repeated pieces, ``repeated`` pieces in all."""

    rounds: int = 0
    repeated: int = 0


def sequential(
    df: DataFrame, keys: list[str], rule: Rule, part_rows: int = skew.PART_ROWS, work: Work | None = None
) -> DataFrame:
    """Apply a rule to each key's rows in order.

    The rule gets at most about ``part_rows`` rows at a time; a key with more is cut into consecutive pieces that run side
    by side.  What enters a piece is found in one of three ways.  Rules with ``until``: every piece is a function from
    the moment that enters to the one that leaves, and the functions are composed by pointer doubling.  Rules that forget
    after a quiet gap: stretches between gaps are independent.  Else (and for stretches that are still too long) pieces run on a
    guess of what enters, and those whose guess was wrong are repeated together until every guess is right.
    """
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(rule.added).fields)
    names = [f.name for f in schema.fields]
    order, work = list(rule.order), work or Work()

    cut, was_split = skew.split_hot(df, keys, order[0], part_rows, order[-1])
    if not was_split:
        return _key_by_key(df, keys, rule)
    if rule.until is not None:
        return _by_moments(cut, keys, rule, schema, work)
    if rule.quiet is not None:
        groups = [*keys, "_session"]
        rows = materialise(skew.sessions(df, keys, order[0], order[1], rule.quiet, part_rows), "sessions")
        long = rows.groupBy(*groups).count().where(F.col("count") > part_rows).drop("count")
        long = materialise(long, "long-sessions")
        if not long.isEmpty():
            rest = sequential(skew.equal_join(rows, long, groups, "left_semi"), groups, replace(rule, quiet=None), part_rows, work)
            short = skew.equal_join(rows, long, groups, "left_anti")
            return _key_by_key(short, groups, rule).select(*names).unionByName(rest.select(*names))
        return _key_by_key(rows, groups, rule).select(*names)
    return _by_guesses(cut, keys, rule, schema, work)


def _key_by_key(df: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """The rule over all rows of each key, many keys to a batch; the state goes on where a batch ends inside a key.

    Tasks read rows sorted by key and order, so a key costs a slice of a batch and not a call of its own.
    """
    added = T.StructType.fromDDL(rule.added)
    names, run = df.columns, rule.run
    spark = df.sparkSession
    # dealt by number: adaptive execution goes by bytes, and the rows are few beside the work on them
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.withColumn(_KEY, F.to_json(F.struct(*keys))).repartition(tasks, _KEY)
    rows = rows.sortWithinPartitions(_KEY, *[F.asc_nulls_last(c) for c in rule.order])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.schema.get_field_index(_KEY)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            mine = batch.select(names)
            # pandas turns whole numbers into floats where one is null: then each key is turned alone
            apart = any(c.null_count and pa.types.is_integer(c.type) for c in mine.columns)
            frame = None if apart else mine.to_pandas()
            out: dict[str, list] = {f.name: [] for f in added}
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part = mine.slice(a, b - a).to_pandas() if apart else frame.iloc[a:b]
                new, state = run(state if key[a] == last else None, part.reset_index(drop=True))
                last = key[a]
                for name, values in new.items():
                    out[name].extend(values)
            columns = [pa.array(out[f.name], to_arrow_type(f.dataType), from_pandas=True) for f in added]
            yield pa.RecordBatch.from_arrays([*mine.columns, *columns], names=[*names, *added.names])

    return rows.mapInArrow(apply, T.StructType(df.schema.fields + added.fields))


SPECULATE = 3  # rounds in which all pieces with news are repeated
_KEY = "_key"  # the key's columns as one text, so that null keys are equal in joins


def _pieces(cut: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, and their key as one text."""
    return materialise(cut.withColumn(_KEY, F.to_json(F.struct(*keys))), "pieces")


def _started(rows: DataFrame, entering: DataFrame, rule: Rule, schema: T.StructType, read: Callable) -> DataFrame:
    """Run every piece on what enters it: ``_key``, ``_part`` and ``_enters``; a piece without any starts empty."""
    names, order, run = [f.name for f in schema.fields], list(rule.order), rule.run

    def piece(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return no_rows(names)
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        new, _ = run(read(before["_enters"].iloc[0]) if len(before) else None, part)
        return part.assign(**new)[names]

    group = [_KEY, "_part"]
    return rows.groupBy(*group).cogroup(entering.groupBy(*group)).applyInPandas(piece, schema)


def _by_guesses(cut: DataFrame, keys: list[str], rule: Rule, schema: T.StructType, work: Work) -> DataFrame:
    """Pieces run from an empty state first; then each gets what left the one before, and those for which this is news run
    again, all together.  Where states that start apart meet, as they do wherever a limit is not reached all the time, nothing is
    news after two or three rounds.  After ``SPECULATE`` rounds only the first wrong piece of each key is repeated, so
    the work stays in proportion to the rows; a key that is over its limit without a break then takes a round a piece.
    """
    order, run, group = list(rule.order), rule.run, [_KEY, "_part"]
    rows = _pieces(cut, keys)
    dense = materialise(rows.where("_part > 0").groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "dense-pieces")
    before = Window.partitionBy(_KEY).orderBy("_part")
    dense = dense.select(*group, F.lag("_part").over(before).alias("_from"))

    def leave(part: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        if part.empty or entering.empty:
            return no_rows([*group, "_enters", "_leaves"])
        text = entering["_enters"].iloc[0]
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        _, state = run(None if text is None else json.loads(text), part)
        return pd.DataFrame({_KEY: [part[_KEY].iloc[0]], "_part": [part["_part"].iloc[0]], "_enters": [text], "_leaves": [json.dumps(state, sort_keys=True)]})

    states = None
    todo = dense.select(*group, F.lit(None).cast("string").alias("_enters"))
    while True:
        chosen = rows.join(todo.select(*group), group, "left_semi")
        ran = chosen.groupBy(*group).cogroup(todo.groupBy(*group)).applyInPandas(
            leave, f"{_KEY} string, _part int, _enters string, _leaves string")
        if states is not None:
            ran = ran.unionByName(states.join(todo.select(*group), group, "left_anti"))
        states = materialise(ran, "piece-states")
        work.rounds += 1
        left = states.select(_KEY, F.col("_part").alias("_from"), F.col("_leaves").alias("_news"))
        told = dense.join(left, [_KEY, "_from"]).join(states, group).where(~F.col("_news").eqNullSafe(F.col("_enters")))
        if work.rounds > SPECULATE:
            told = told.withColumn("_nth", F.row_number().over(Window.partitionBy(_KEY).orderBy("_part"))).where("_nth = 1")
        todo = materialise(told.select(*group, F.col("_news").alias("_enters")), "piece-news")
        count = todo.count()
        if not count:
            break
        work.repeated += count
    entering = states.where("_enters is not null").select(*group, "_enters")
    return _started(rows, entering, rule, schema, json.loads)


def _by_moments(cut: DataFrame, keys: list[str], rule: Rule, schema: T.StructType, work: Work) -> DataFrame:
    """Compose the pieces of each key for a rule with ``until``.

    In a piece every row points to the first row at or after the moment it sets; following the pointers, a row leaves the
    piece with one moment, and so does every moment that enters it.  A moment that leaves a piece enters the first one that
    reaches so far.  That makes a pointer from each leaving moment to the next one; those on the path from a key's first row are
    found by doubling the pointers, in as many joins as the number of pieces has binary digits.
    """
    order, until, group = list(rule.order), rule.until, [_KEY, "_part"]
    rows = _pieces(cut, keys)
    dense = rows.where("_part > 0")
    spans = materialise(dense.groupBy(*group).agg(F.max(order[0]).alias("high")), "piece-spans")
    # a row per piece of more than part_rows rows: the only thing here that is sent to every task
    ends: dict[str, tuple[list, list]] = {}
    for key, part, high in spans.orderBy(*group).collect():
        parts, highs = ends.setdefault(key, ([], []))
        parts.append(part)
        highs.append(high)
    held = rows.sparkSession.sparkContext.broadcast({k: (np.array(p), np.array(h)) for k, (p, h) in ends.items()})

    def leaving(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The times of the rows in order, and the moment with which each leaves the piece if it sets one."""
        part = part.sort_values(order, kind="stable")
        at, moment = part[order[0]].to_numpy(np.int64), until(part)
        follow = np.maximum(np.searchsorted(at, moment), np.arange(len(at)) + 1)
        last = np.where(follow < len(at), follow, np.arange(len(at)))
        while (last[last] != last).any():
            last = last[last]
        return at, moment[last]

    def target(key: str, moments: np.ndarray) -> np.ndarray:
        parts, highs = held.value[key]
        place = np.searchsorted(highs, moments)
        return np.append(parts, -1)[place]

    def exits(part: pd.DataFrame) -> pd.DataFrame:
        key, number = part[_KEY].iloc[0], part["_part"].iloc[0]
        _, moments = leaving(part)
        distinct = np.unique(moments)
        return pd.DataFrame({_KEY: key, "_part": number, "_moment": distinct, "_to": target(key, distinct), "_head": distinct == moments[0]})

    nodes = dense.groupBy(*group).applyInPandas(exits, f"{_KEY} string, _part int, _moment long, _to int, _head boolean")
    nodes = materialise(nodes, "piece-exits")

    def pass_through(part: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        if part.empty or entering.empty:
            return no_rows([_KEY, "_part", "_moment", "_next_part", "_next"])
        at, moments = leaving(part)
        out = entering[[_KEY, "_from", "_moment"]].rename(columns={"_from": "_part"})
        return out.assign(_next_part=part["_part"].iloc[0], _next=moments[np.searchsorted(at, entering["_moment"].to_numpy(np.int64))])

    entering = nodes.where("_to > 0").select(_KEY, F.col("_part").alias("_from"), "_moment", F.col("_to").alias("_part"))
    links = dense.groupBy(*group).cogroup(entering.groupBy(*group)).applyInPandas(
        pass_through, f"{_KEY} string, _part int, _moment long, _next_part int, _next long")
    links = materialise(links, "piece-links")
    node = [_KEY, "_part", "_moment"]
    first = spans.groupBy(_KEY).agg(F.min("_part").alias("_part"))
    reached = materialise(nodes.where("_head").join(first, [_KEY, "_part"]).select(*node), "reached")
    longest = max(len(p) for p, _ in ends.values())
    for _ in range(max(1, (longest - 1).bit_length())):
        step = reached.join(links, node).select(_KEY, F.col("_next_part").alias("_part"), F.col("_next").alias("_moment"))
        reached = materialise(reached.unionByName(step).distinct(), "reached")
        ahead = links.select(_KEY, F.col("_part").alias("_next_part"), F.col("_moment").alias("_next"), F.col("_next_part").alias("p"), F.col("_next").alias("m"))
        links = materialise(links.join(ahead, [_KEY, "_next_part", "_next"]).select(*node, F.col("p").alias("_next_part"), F.col("m").alias("_next")), "piece-links")
        work.rounds += 1
    earlier = Window.partitionBy(_KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    left = spans.join(reached, group, "left").select(*group, F.max("_moment").over(earlier).alias("_enters")).where("_enters is not null")
    return _started(rows, left, rule, schema, int)


def limit_rule(time: str, tie: str, limit: int = fixed.RATE_LIMIT, window_seconds: int = fixed.RATE_WINDOW_SECONDS) -> Rule:
    """Sliding-window limit; adds ``allowed``.  ``time`` is in microseconds."""

    def run(state, rows):
        hits = state or []
        return {"allowed": [limit_step(hits, t, limit, window_seconds * SECOND) for t in rows[time].tolist()]}, hits

    return Rule(run, "allowed boolean", (time, tie), window_seconds * SECOND)


def two_level_rule(
    browser: str, time: str, tie: str, limit: int = fixed.RATE_LIMIT, factor: int = fixed.NETWORK_FACTOR,
    window_seconds: int = fixed.RATE_WINDOW_SECONDS,
) -> Rule:
    """Limit per browser, then per network (the key); adds ``verdict``."""

    def run(state, rows):
        state = state or {}
        pairs = zip(rows[browser].astype(str).tolist(), rows[time].tolist(), strict=True)
        return {"verdict": [
            two_level_step(state, b, t, limit, limit * factor, window_seconds * SECOND) for b, t in pairs]}, state

    return Rule(run, "verdict string", (time, tie), window_seconds * SECOND)


def hold_rule(time: str, tie: str, seconds: int | str = fixed.TTL_SECONDS, flag: str = "hit") -> Rule:
    """Reuse within a fixed time of the first answer; adds ``flag``.  ``seconds``: a number, or a column of numbers."""

    def holds(rows):
        return [seconds] * len(rows) if isinstance(seconds, int) else rows[seconds].tolist()

    def run(expires, rows):
        out = []
        for t, h in zip(rows[time].tolist(), holds(rows), strict=True):
            hit, expires = hold_step(expires, t, int(h * SECOND))
            out.append(hit)
        return {flag: out}, expires

    def until(rows):
        return rows[time].to_numpy(np.int64) + np.array([int(h * SECOND) for h in holds(rows)], np.int64)

    return Rule(run, f"{flag} boolean", (time, tie), seconds * SECOND if isinstance(seconds, int) else None, until)


def breaker_rule(
    time: str, tie: str, outcome: str, threshold: int = fixed.BREAKER_THRESHOLD,
    cooldown_seconds: int = fixed.BREAKER_COOLDOWN_SECONDS,
) -> Rule:
    """Circuit breaker over a call log; adds ``allowed``, ``status``, ``retry_in`` as they are after each call."""

    def run(state, rows):
        state = state or {}
        allowed, status, retry = [], [], []
        for t, o in zip(rows[time].tolist(), rows[outcome].tolist(), strict=True):
            allowed.append(breaker_step(state, t, o, threshold, cooldown_seconds * SECOND))
            s, r = breaker_status(state, t, cooldown_seconds * SECOND)
            status.append(s)
            retry.append(r)
        return {"allowed": allowed, "status": status, "retry_in": retry}, state

    return Rule(run, "allowed boolean, status string, retry_in int", (time, tie))


def escalation_rule(turn: str, reason: str, email: str) -> Rule:
    """Escalation state of a conversation; adds ``action`` and ``ticket_reason``."""

    def run(state, rows):
        state = state or {}
        action, why = [], []
        for r, e in zip(rows[reason].tolist(), rows[email].tolist(), strict=True):
            a, w = escalation_step(state, r if isinstance(r, str) else None, isinstance(e, str))
            action.append(a)
            why.append(w)
        return {"action": action, "ticket_reason": why}, state

    return Rule(run, "action string, ticket_reason string", (turn,))


def rate_limit(df, keys, time, tie, limit, window_seconds, part_rows: int = skew.PART_ROWS) -> DataFrame:
    return sequential(df, keys, limit_rule(time, tie, limit, window_seconds), part_rows)


def ttl_reuse(df, keys, time, tie, ttl_seconds: int = fixed.TTL_SECONDS, part_rows: int = skew.PART_ROWS) -> DataFrame:
    return sequential(df, keys, hold_rule(time, tie, ttl_seconds), part_rows)


def single_flight(df, keys, time, tie, duration: str, part_rows: int = skew.PART_ROWS) -> DataFrame:
    """Requests that arrive while an equal one is under way share its result; adds ``shared``."""
    return sequential(df, keys, hold_rule(time, tie, duration, "shared"), part_rows)


def circuit_state(df, keys, time, tie, outcome, part_rows: int = skew.PART_ROWS) -> DataFrame:
    return sequential(df, keys, breaker_rule(time, tie, outcome), part_rows)


def rate_limit_two_level(
    df, network, browser, time, tie, limit, factor, window_seconds, part_rows: int = skew.PART_ROWS
) -> DataFrame:
    return sequential(df, [network], two_level_rule(browser, time, tie, limit, factor, window_seconds), part_rows)


def escalation_flow(df, keys, turn, reason, email, part_rows: int = skew.PART_ROWS) -> DataFrame:
    return sequential(df, keys, escalation_rule(turn, reason, email), part_rows)


def lru_hits(
    df: DataFrame, keys: list[str], time: str, tie: str, item: str, capacity: int, part_rows: int = skew.PART_ROWS
) -> DataFrame:
    """Would each request hit a least-recently-used cache of ``capacity`` items?  Adds ``hit``.

    The cache holds the last ``capacity`` distinct items, so what it holds at the start of a piece follows from the last
    use of each item in earlier pieces: pieces run side by side.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("hit", T.BooleanType())])
    names = [f.name for f in schema.fields]

    def run(rows: pd.DataFrame, start: list) -> pd.DataFrame:
        rows = rows.sort_values([time, tie], kind="stable").reset_index(drop=True)
        cache, hits = OrderedDict.fromkeys(start), []
        for x in rows[item].tolist():
            hits.append(x in cache)
            cache[x] = None
            cache.move_to_end(x)
            if len(cache) > capacity:
                cache.popitem(last=False)
        return rows.assign(hit=hits)[names]

    cut, was_split = skew.split_hot(df, keys, time, part_rows, tie)
    if not was_split:
        return df.groupBy(*keys).applyInPandas(lambda pdf: run(pdf, []), schema)

    last = cut.groupBy(*keys, "_part", item).agg(F.max(F.struct(time, tie)).alias("_at"))
    newest = Window.partitionBy(*keys, "_part").orderBy(F.desc("_at"))
    last = last.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= capacity).drop("_nth")
    last = materialise(last, "last-use")  # at most capacity rows per piece
    pieces = last.select(*keys, F.col("_part").alias("_at_part")).distinct()
    before = last.join(pieces, keys).where(F.col("_part") < F.col("_at_part"))
    before = before.groupBy(*keys, "_at_part", item).agg(F.max("_at").alias("_at"))
    newest = Window.partitionBy(*keys, "_at_part").orderBy(F.desc("_at"))
    start = (
        before.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= capacity)
        .select(*keys, F.col("_at_part").alias("_part"), item, "_nth")
    )
    group = [*keys, "_part"]

    def piece(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return no_rows(names)
        return run(rows, held.sort_values("_nth", ascending=False)[item].tolist())

    return cut.groupBy(*group).cogroup(start.groupBy(*group)).applyInPandas(piece, schema)


def cache_stats(reused: DataFrame, keys: list[str], entry: str, flag: str = "hit", most: int = fixed.MAX_ENTRIES) -> DataFrame:
    """Use of a cache per group: requests, hits, misses, hit rate and the entries it holds at the end (``most`` at most)."""
    hits = F.count_if(F.col(flag))
    total = F.count(F.lit(1))
    return reused.groupBy(*keys).agg(
        total.alias("requests"), hits.alias("hits"), (total - hits).alias("misses"),
        F.round(F.coalesce(F.try_divide(hits.cast("double"), total.cast("double")), F.lit(0.0)), 2).alias("hit_rate"),
        F.least(F.count_distinct(F.when(~F.col(flag), F.col(entry))), F.lit(most).cast("bigint")).alias("entries"),
    )


def classify_error(status, names) -> F.Column:
    """Kind of a failed call from its status code, else from the class name of its error."""
    low = F.lower(F.coalesce(names, F.lit("")))
    slow = ["timeouterror", "apitimeouterror", "timeoutexception", "readtimeout", "connecttimeout"]
    lost = ["connectionerror", "apiconnectionerror", "connecterror", "gaierror", "oserror", "networkerror"]
    return (
        F.when(status.isin(401, 403), "auth")
        .when(status.isin(400, 404, 422), "model")
        .when(status.isNull() & low.isin(slow), "transient")
        .when(status.isNull() & low.isin(lost), "network")
        .when(status.isin(408, 409, 425, 429) | (status >= 500), "transient")
        .otherwise("other")
    )
