"""Keyed state for Structured Streaming.  Rules are the ones the batch operators use."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators.sequences import Rule, no_rows


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    columns = zip(*rows) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, columns, strict=True)})


def _plain(chunk: pd.DataFrame, names: list[str]) -> list[list]:
    """Rows as lists that JSON can hold."""
    columns = [chunk[n].astype(object).where(chunk[n].notna(), None).tolist() if chunk[n].isna().any() else chunk[n].tolist() for n in names]
    return [list(r) for r in zip(*columns, strict=True)]


def is_empty(state: Any) -> bool:
    return not state or isinstance(state, dict) and not any(state.values())


def apply_rule(rule: Rule, state: Any, rows: list, names: list[str]) -> tuple[pd.DataFrame, Any]:
    """Rows in the rule's order with its new columns, and the state after them."""
    frame = _frame(rows, names).sort_values(list(rule.order), kind="stable").reset_index(drop=True)
    new, after = rule.run(state, frame)
    return frame.assign(**new), after


def apply_by_key(rule: Rule, enter: Callable[[str], Any], rows: list, names: list[str], keys: list[str]) -> tuple[pd.DataFrame, dict[str, tuple[Any, int]]]:
    """Rows of many keys, each key's in the rule's order, with the new columns; by key the state after it and its number of rows.

    A key is one text, which Spark can take apart again.
    """
    key, order = itemgetter(*[names.index(n) for n in keys]), [names.index(n) for n in rule.order]
    groups: dict[Any, list] = {}
    for row in rows:
        groups.setdefault(key(row), []).append(row)
    for mine in groups.values():
        try:
            mine.sort(key=itemgetter(*order))
        except TypeError:  # a null is no number: nulls come last
            mine.sort(key=lambda row: [(row[i] is None, row[i]) for i in order])
    frame = _frame([row for mine in groups.values() for row in mine], names)
    added: dict[str, list] = {}
    after, start = {}, 0
    for values, mine in groups.items():
        name = json.dumps(dict(zip(keys, values if len(keys) > 1 else [values], strict=True)), ensure_ascii=False)
        new, state = rule.run(enter(name), frame.iloc[start:start + len(mine)].reset_index(drop=True))
        for column, found in new.items():
            added.setdefault(column, []).extend(found.tolist() if hasattr(found, "tolist") else found)
        after[name], start = (state, len(mine)), start + len(mine)
    return frame.assign(**{n: pd.Series(v, dtype=object) for n, v in added.items()}), after


SLOTS = 4_096  # keys with event time share so many places in the state
SLOT = "_slot"
CHUNK_ROWS = 2_000  # waiting rows in one entry of the map
SHARED_ROWS = 64  # buckets with fewer rows share an entry until it has so many
BUCKET_SECONDS = 3_600


class RuleProcessor(StatefulProcessor):
    """Applies a rule to the rows of a key and keeps its state between micro-batches.

    With event time, keys are dealt over ``SLOTS`` slots by hash, and a slot is what Spark takes for the key: a call for a key costs
    more than the work on its rows.  Rows wait in a map from (bucket of time, number) to a chunk of rows.  New rows are only ever appended.  A call to
    the state store costs more than a few rows do, so buckets of few rows share an entry, filed under its first bucket; when that is due,
    what is not is filed again.  Larger entries hold one bucket and are not read before its time.  One timer stands for the
    first bucket that waits.  When the watermark has passed its end, due buckets are read, taken in time order, whatever batch
    brought their rows, and removed: memory holds one bucket of one slot, and the entries that a few rows share.
    Rows behind the watermark never come here (Spark counts them).  The rule's own states are a map apart, by key; a state goes when
    nothing within ``keep_ms`` of the key's last row can still come, or as soon as the rule leaves it empty.  Without event time rows are
    taken key by key and batch by batch, and state goes when the rule leaves it empty.
    """

    def __init__(self, rule: Rule, names: list[str], out: list[str], time: str | None, keep_ms: int | None, bucket_ms: int, keys: list[str]) -> None:
        self.rule, self.names, self.out, self.time, self.keys = rule, names, out, time, keys
        self.keep_ms, self.bucket_ms = keep_ms, bucket_ms
        self.at = names.index(time) if time else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if not self.time:
            self.state = handle.getValueState("state", "body string, last bigint")
            return
        self.state = handle.getMapState("state", "key string", "body string, last bigint")
        self.waiting = handle.getMapState("waiting", "bucket bigint, number int", "body string")
        self.counts = handle.getValueState("counts", "body string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if not self.time:
            state = json.loads(self.state.get()[0]) if self.state.exists() else None
            fresh = [r for chunk in rows for r in _plain(chunk, self.names)]
            done, state = apply_rule(self.rule, state, fresh, self.names)
            if is_empty(state):
                self.state.clear()
            else:
                self.state.update((json.dumps(state, ensure_ascii=False), None))
            yield done[self.out]
            return
        counts = self._counts()
        first = min(counts, default=None)
        for frame in rows:
            self._file(_plain(frame, self.names), counts)
        if counts and (first is None or min(counts) < first):
            self.handle.registerTimer((min(counts) + 1) * self.bucket_ms)
        self._note(counts)
        yield from ()

    def _bucket(self, row: list) -> int:
        return int(row[self.at] // (self.bucket_ms * 1000))

    def _counts(self) -> dict[int, int]:
        """How many entries are filed under each bucket."""
        return {int(b): n for b, n in json.loads(self.counts.get()[0]).items()} if self.counts.exists() else {}

    def _note(self, counts: dict[int, int]) -> None:
        self.counts.update((json.dumps(counts),)) if counts else self.counts.clear()

    def _file(self, rows: list, counts: dict[int, int]) -> None:
        """Write rows that wait as entries of the map."""
        buckets: dict[int, list] = {}
        for row in rows:
            if row[self.at] is not None:
                buckets.setdefault(self._bucket(row), []).append(row)
        shared: list = []
        entries: list[tuple[int, list]] = []
        for bucket in sorted(buckets):
            mine = buckets[bucket]
            if len(mine) >= SHARED_ROWS:
                entries += [(bucket, mine[i:i + CHUNK_ROWS]) for i in range(0, len(mine), CHUNK_ROWS)]
                continue
            if not shared or len(shared[-1][1]) + len(mine) > SHARED_ROWS:
                shared.append((bucket, []))
            shared[-1][1].extend(mine)
        for bucket, mine in entries + shared:
            number = counts.get(bucket, 0)
            self.waiting.updateValue((bucket, number), (json.dumps(mine, ensure_ascii=False),))
            counts[bucket] = number + 1

    def _enter(self, key: str) -> Any:
        held = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return json.loads(held[0]) if held else None

    def _judge(self, due: list) -> pd.DataFrame:
        """The rule over the rows of one bucket; the states after them are kept."""
        done, after = apply_by_key(self.rule, self._enter, due, self.names, self.keys)
        times, start = done[self.time].tolist(), 0
        for key, (state, n) in after.items():
            if not is_empty(state):
                self.state.updateValue((key,), (json.dumps(state, ensure_ascii=False), max(times[start:start + n])))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))
            start += n
        return done[self.out]

    def _expire(self, upto: int) -> int | None:
        """Drop states that no row to come can need; the moment at which the next one goes.

        What still waits or comes is in a bucket that the watermark has not passed.
        """
        begin = upto // self.bucket_ms * self.bucket_ms
        ends = {key[0]: -(-(held[1] // 1000 + self.keep_ms) // self.bucket_ms) * self.bucket_ms for key, held in list(self.state.iterator())}
        for key, end in ends.items():
            if end <= begin:
                self.state.removeKey((key,))
        return min((end for end in ends.values() if end > begin), default=None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        counts = self._counts()
        first, took = min(counts, default=None), False
        while counts and (min(counts) + 1) * self.bucket_ms <= upto:
            bucket, due, rest = min(counts), [], []
            for number in range(counts.pop(bucket)):
                for row in json.loads(self.waiting.getValue((bucket, number))[0]):
                    (due if self._bucket(row) == bucket else rest).append(row)
                self.waiting.removeKey((bucket, number))
            # small buckets that come due together and have no entry of their own need not be filed in between
            while rest:
                following = min(map(self._bucket, rest))
                if (following + 1) * self.bucket_ms > upto or counts and min(counts) <= following:
                    break
                due += [row for row in rest if self._bucket(row) == following]
                rest = [row for row in rest if self._bucket(row) != following]
            self._file(rest, counts)
            took = True
            yield self._judge(due)
        if took:
            self._note(counts)
        if counts and min(counts) != first:
            self.handle.registerTimer((min(counts) + 1) * self.bucket_ms)
        if self.keep_ms is not None:
            following = self._expire(upto)
            if following is not None:
                self.handle.registerTimer(following)

    def close(self) -> None:
        pass


def _columns(stream: DataFrame, rule: Rule) -> tuple[list[str], T.StructType]:
    fields = [f for f in stream.schema.fields if not isinstance(f.dataType, T.TimestampType) and f.name != SLOT]
    return [f.name for f in fields], T.StructType(fields + T.StructType.fromDDL(rule.added).fields)


def stateful(stream: DataFrame, keys: list[str], rule: Rule, time: str | None = None, keep_seconds: int | None = None,
             bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """A rule over a stream.  With ``time`` (a column of microseconds) the stream needs a watermark on the same moment.

    Rows come out when the watermark has passed their bucket of ``bucket_seconds``: wider buckets take fewer state
    entries, narrower ones hold less in memory and answer sooner.  Queries on it need the RocksDB state store
    (``jobs.run_stream`` sets it for the query it starts).
    """
    names, schema = _columns(stream, rule)
    keep_ms = keep_seconds * 1000 if keep_seconds is not None else None
    processor = RuleProcessor(rule, names, schema.names, time, keep_ms, bucket_seconds * 1000, keys)
    rows = stream.withColumn(SLOT, F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")) if time else stream
    return rows.groupBy(*([SLOT] if time else keys)).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append",
        timeMode="EventTime" if time else "none")


def _held(spark: SparkSession, marks: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(marks)


def states(stream: DataFrame, keys: list[str], marks: str) -> DataFrame:
    """States that a stopped stream with event time has left: the key's columns and ``body``."""
    fields = T.StructType([stream.schema[k] for k in keys])
    held = _held(stream.sparkSession, marks, "state")
    return held.select(F.from_json("user_map_key.key", fields).alias("k"), F.col("user_map_value.body").alias("body")).select("k.*", "body")


def waiting(stream: DataFrame, keys: list[str], rule: Rule, marks: str) -> DataFrame:
    """Rows that still wait for the watermark when a stream has stopped, with the rule applied; read from its checkpoint.

    The last row of a key carries the state after it in ``_state``.  What waits is what the watermark's delay and one
    bucket hold; a task takes one slot at a time.
    """
    names, schema = _columns(stream, rule)
    linked = T.StructType([*schema.fields, T.StructField("_state", T.StringType())])
    slot, spark = F.col(f"key.{SLOT}").alias(SLOT), stream.sparkSession
    rows = _held(spark, marks, "waiting").select(slot, F.col("user_map_value.body").alias("body"))
    state = _held(spark, marks, "state").select(slot, F.col("user_map_key.key").alias("held"), F.col("user_map_value.body").alias("body"))

    def run(key: tuple, bodies: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if bodies.empty:
            return no_rows(linked.names)
        entering = dict(zip(before["held"], before["body"], strict=True))
        rows = [r for body in bodies["body"] for r in json.loads(body)]
        done, after = apply_by_key(rule, lambda k: json.loads(entering[k]) if k in entering else None, rows, names, keys)
        left = []
        for after_key, n in after.values():
            left += [None] * (n - 1) + [json.dumps(after_key, ensure_ascii=False)]
        return done.assign(_state=pd.Series(left, dtype=object))[linked.names]

    return rows.groupBy(SLOT).cogroup(state.groupBy(SLOT)).applyInPandas(run, linked)
