"""How quality filters interact: what each removes in every order, alone, redundantly and on average.

1. One pass over the texts turns each into a mask (a bit per failing filter of the text alone) and a 128-bit digest.
2. **Duplicate prepass.** Every task counts its digests in a counting Bloom sketch (four cells of one segment of ``CELLS`` counters per
   text); the sketches are merged by adding.  A text with a cell that only it has touched is unique for sure.  The sketch grows
   with the table: ``TEXTS`` texts a segment, which clears about 99.8% of unique texts.
3. Only possible repeats are shuffled, as whole texts, for the smallest id of each.  Copies are summed up before the shuffle, so a
   text that holds a third of all rows is one row per task.
4. Masks are counted per part without duplicates; a duplicate moves its count to the mask with its bit. Labels join the narrow table.
   All figures of all orders are sums over these counts.

At the text scan the sketch is two bytes a text, broadcast up to ``SKETCH_BYTES``; beyond, narrow rows meet its segments in a join and
the texts of what is possibly repeated are fetched by id.

Defined results: a null text is empty; a null part is the empty string; a row without an id is never a duplicate and makes none;
rows with equal id and text are not duplicates of each other; a text is good or toxic if any label row of its id says
so; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import share, shared, small_batches
from tidewell.operators.skew import spread_join
from tidewell.session import materialise

MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SIGNS = b"#$%&*|"
LETTERS = "ABCDE"  # the last one marks duplicates
CELLS = 1 << 14
TEXTS = 1 << 10
PLACES = 4  # cells of one text, 14 bits of the digest each
SKETCH_BYTES = 64 << 20
FLUSH = 1 << 20

_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # bytes inside a code point


def failures(text: bytes) -> int:
    """The mask of one text: few words, few distinct words, many capitals, signs."""
    words = text.split()  # at 0x20 and 0x09-0x0D
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > UPPER_PERCENT * points) << 2
        | (len(text) > len(text.translate(None, SIGNS))) << 3
    )


def cells_of(digests: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each digest (rows of two 64-bit numbers) and its ``PLACES`` cells there."""
    shifts = np.arange(PLACES, dtype=np.uint64) * np.uint64(14)
    cells = (digests[:, 1:] >> shifts) & np.uint64(CELLS - 1)
    return (digests[:, 0] % np.uint64(segments)).astype(np.int64), cells.astype(np.int64)


def as_numbers(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)


def facts(docs: DataFrame, judge: Callable[[bytes], int] = failures, key: str = "doc_id", text: str = "text", part: str = "lang",
          sketch=None, segments: int = 0) -> DataFrame:
    """``key``, ``part``, ``mask`` and ``digest`` of every row; with a ``sketch``, only of possible repeats, and their texts."""
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["key"].dataType.simpleString()
    names = ["key", "part", "mask", "digest"] + (["text"] if segments else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared(sketch) if sketch is not None else None
        for batch in batches:
            if bits is not None:
                batch = batch.filter(batch.column(0).is_valid())
            texts = batch.column(2).to_pylist()
            digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            if bits is not None and len(texts):
                chosen = np.flatnonzero(possibly_repeated(as_numbers(digests), bits, segments))
                batch, digests, texts = batch.take(pa.array(chosen)), digests.take(pa.array(chosen)), [texts[i] for i in chosen]
            columns = [batch.column(0), batch.column(1), pa.array(map(judge, texts), pa.int32()), digests, batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns[:len(names)], names)

    return rows.mapInArrow(run, f"key {id_type}, part string, mask int, digest binary" + (", text binary" if segments else ""))


def possibly_repeated(digests: np.ndarray, bits: np.ndarray, segments: int) -> np.ndarray:
    """Whether all cells of a digest were touched twice; ``bits`` has a row of CELLS / 8 bytes per segment."""
    segment, cells = cells_of(digests, segments)
    return ((bits[segment[:, None], cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all(axis=1)


def merged_sketch(digests: DataFrame, segments: int) -> DataFrame:
    """``segment`` and ``bits`` (one per cell: touched at least twice) from the counting sketches of all tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            touched, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            segment, cell = touched // CELLS, (touched % CELLS).astype(np.uint16)
            numbers, first = np.unique(segment, return_index=True)
            ends = np.append(first[1:], len(segment))
            return pa.RecordBatch.from_arrays([
                pa.array(numbers), pa.array([cell[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], ["segment", "cells", "counts"])

        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                segment, cells = cells_of(as_numbers(batch.column(0)), segments)
                held.append((segment[:, None] * CELLS + cells).ravel())
            if sum(map(len, held)) >= PLACES * FLUSH:
                yield flush()
                held = []
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        for cells, counts in zip(table["cells"].to_pylist(), table["counts"].to_pylist()):
            total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint8)
        bits = np.packbits(total >= 2, bitorder="little").tobytes()
        return pa.table({"segment": pa.array([table["segment"][0].as_py()], pa.int64()), "bits": pa.array([bits], pa.binary())})

    parts = digests.select("digest").mapInArrow(count, "segment long, cells binary, counts binary")
    return materialise(parts.groupBy("segment").applyInArrow(merge, "segment long, bits binary"), "sketch")


def possible_repeats(docs: DataFrame, narrow: DataFrame, rows: int, sketch_bytes: int = SKETCH_BYTES, **more) -> DataFrame:
    """``facts`` with texts of all rows that may share their text with another one."""
    spark, segments = docs.sparkSession, math.ceil(rows / TEXTS)
    sketch = merged_sketch(narrow, segments)
    key = more.get("key", "doc_id")
    if segments * CELLS // 8 <= sketch_bytes:
        bits = np.zeros((segments, CELLS // 8), np.uint8)
        for segment, row in sketch.toLocalIterator():
            bits[segment] = np.frombuffer(row, np.uint8)
        return facts(docs, sketch=share(spark, bits), segments=segments, **more)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cells = cells_of(as_numbers(batch.column(1)), segments)
                bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                hit = (np.take_along_axis(bits, cells >> 3, 1) >> (cells & 7).astype(np.uint8) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], ["key"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                segment, _ = cells_of(as_numbers(batch.column(1)), segments)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], ["key", "digest", "segment"])

    id_type = narrow.schema["key"].dataType.simpleString()
    placed = narrow.where("key is not null").select("key", "digest").mapInArrow(number, f"key {id_type}, digest binary, segment long")
    with small_batches(spark):  # a row carries a segment
        keys = materialise(placed.join(sketch, "segment").select("key", "digest", "bits").mapInArrow(look_up, f"key {id_type}"), "repeats")
    found = docs.join(keys.distinct(), docs[key] == F.col("key"), "left_semi")
    return facts(found, segments=segments, **more)


def duplicates(docs: DataFrame, narrow: DataFrame, rows: int, **more) -> DataFrame:
    """``key``, ``part`` and ``mask`` of every row whose text some row with a smaller key has too."""
    if not rows:
        return narrow.select("key", "part", "mask")
    with small_batches(docs.sparkSession):
        repeats = materialise(possible_repeats(docs, narrow, rows, **more), "possible-repeats")
    first = repeats.groupBy("digest", "text").agg(F.min("key").alias("key")).select("key", "digest")
    return repeats.select("key", "part", "mask", "digest").where("key is not null").join(first, ["key", "digest"], "left_anti").drop("digest")


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", bit: int = 1 << (len(LETTERS) - 1), **more) -> DataFrame:
    """``part``, ``mask`` and how many ``rows``, ``good`` and ``toxic`` ones there are, duplicates marked by ``bit``."""
    own = {k: v for k, v in more.items() if k != "sketch_bytes"}
    with small_batches(docs.sparkSession):
        narrow = materialise(facts(docs, key=key, **own), "masks")
    copies = duplicates(docs, narrow, narrow.count(), key=key, **more)
    every = narrow.select("key", "part", "mask", F.lit(1).alias("n"))
    every = every.unionByName(copies.withColumn("n", F.lit(-1))).unionByName(
        copies.withColumn("mask", F.col("mask").bitwiseOR(F.lit(bit))).withColumn("n", F.lit(1)))
    marks = labels.groupBy(F.col(key).alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = spread_join(every, marks.where("key is not null"), "key")
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from counts per mask."""
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "bit": 1 << letters.index(f), "before": sum(1 << letters.index(x) for x in order[:i])}
        for order in itertools.permutations(letters) for i, f in enumerate(order)]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = counts.withColumn("s", F.explode(table)).select(*counts.columns, "s.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    orders = F.lit(math.factorial(len(letters)))

    def total(name: str, condition, value=F.col("rows")):
        return F.sum(F.when(condition, value).otherwise(0)).cast("bigint").alias(name)

    return rows.groupBy("part", "filter_order", "step").agg(
        total("kept", ~fails & ~gone), total("removed", fails & ~gone), total("redundant", fails & gone),
        total("unique_fails", F.col("mask") == F.col("bit")), total("good_lost", fails & ~gone, F.col("good")),
        total("toxic_lost", fails & ~gone, F.col("toxic")),
        total("shapley", fails, F.col("rows") * (orders / F.bit_count("mask")).cast("bigint")))


def audit(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """All orders of the five filters over ``docs``."""
    return interactions(materialise(mask_counts(docs, labels, **more), "mask-counts"))


def oracle() -> str:
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(LETTERS))
    names = [f"{f}{i}" for i, f in enumerate("fghij", 1)]
    orders = f"select {' || '.join(f'{n}.f' for n in names)} as o, [{', '.join(f'{n}.b' for n in names)}] as bits from {', '.join(f'letters {n}' for n in names)} " \
        "where " + " and ".join(f"{a}.f <> {b}.f" for a, b in itertools.combinations(names, 2))
    return f"""
        with words as (
            select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
            from documents),
        masks as (
            select doc_id, part,
                (len(w) < {MIN_WORDS})::int + 2 * (100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w))::int
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text))::int
                + 8 * regexp_matches(text, '[#$%&*|]')::int
                + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
            from words),
        marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
        counts as (
            select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
            from masks left join marks using (doc_id) group by 1, 2),
        letters(f, b) as (values {letters}),
        orders as ({orders}),
        steps as (
            select o as filter_order, i as step, bits[i] as bit, coalesce(list_sum(bits[1:i - 1]), 0)::int as before
            from orders, range(1, 6) t(i))
        select part, filter_order, step::int as step,
            sum(case when mask & (before + bit) = 0 then n else 0 end)::bigint as kept,
            sum(case when mask & bit <> 0 and mask & before = 0 then n else 0 end)::bigint as removed,
            sum(case when mask & bit <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant,
            sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
            sum(case when mask & bit <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
            sum(case when mask & bit <> 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost,
            sum(case when mask & bit <> 0 then n * (120 // bit_count(mask)) else 0 end)::bigint as shapley
        from counts, steps group by 1, 2, 3"""
