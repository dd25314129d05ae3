"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features are words, runs of signs and pairs of neighbours, hashed into ``BUCKETS`` buckets.  The raw model counts the buckets over
all texts in a plain scan, the target model over all texts labelled good.  For the latter a Bloom filter of the good ids (``BITS`` a id,
``FILTER_BYTES`` at most) lets only texts pass that may be good, and these meet the ids in a sort-merge join: texts that are not
good hardly move, and the plan is the same at every size.  A text's weight is the ratio of its chances under both models (the sum of logs over its features).
Each text's log weight plus a Gumbel number from a hash of its id is its key, and the texts with the k largest keys stay:
sampling without replacement in proportion to the weights.  By default k is the share of good texts among the labelled ones.

The models are ``BUCKETS`` numbers each; the k-th key is found by counting, without a global sort.

Defined results: a null or empty text has weight 1 (log 0); texts with the k-th key stay together; without texts labelled good all weights
are 1 and ``without_target`` of the texts stay (all by default); a null id is hashed as the empty text; repeated rows share their
key; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import small_batches, written
from tidewell.llm.mixing import uniform
from tidewell.llm.words import WordHasher, mix
from tidewell.operators.skew import order_statistics
from tidewell.session import materialise

BUCKETS = 10_000
PRIOR = 1.0
SEED = 31
BITS, HASHES = 16, 4  # of the filter of good ids: under one wrong id of four hundred passes
FILTER_BYTES = 64 << 20


def features(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and of every pair of neighbours; the second array marks words that have a right neighbour."""
    ones = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    pairs = np.zeros(len(hashes), np.int64)
    inner = np.ones(len(hashes), bool)
    ends = bounds[1:] - 1
    inner[ends[ends >= bounds[:-1]]] = False
    left = np.flatnonzero(inner)
    pairs[left] = (mix(hashes[left] * np.uint64(3) ^ hashes[left + 1]) % np.uint64(BUCKETS)).astype(np.int64)
    return ones, np.where(inner, pairs, -1)


def id_filter(ids: DataFrame, name: str, most_bytes: int = FILTER_BYTES) -> tuple[np.ndarray, int]:
    """Words of a Bloom filter over the ids in column ``name``, and its number of bits (a multiple of 64).

    Bits are set in Spark: a row per word of 64 bits that is not 0 reaches the driver, ``most_bytes / 8`` at most.
    """
    count = ids.count()
    bits = 64 * max(1, min(-(-count * BITS // 64), most_bytes // 8))
    cell = F.explode(F.array(*places(F.col(name), bits)))
    words = ids.select(cell.alias("cell")).groupBy((F.col("cell") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("cell", F.lit(64)).cast("int"))).alias("set"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
    return out, bits


def places(key: Column, bits: int) -> list[Column]:
    """The bits that stand for a key."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _counted(texts: DataFrame, name: str) -> np.ndarray:
    """How often each bucket occurs in the texts of the only column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(signs=True), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, hashes, bounds in hasher.column(batch.column(0)):
                both = np.concatenate(features(hashes, bounds))
                counts += np.bincount(both[both >= 0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts)], ["bucket", name])

    parts = texts.mapInArrow(run, f"bucket long, {name} long")
    out = np.zeros(BUCKETS)
    with small_batches(texts.sparkSession):
        for bucket, n in parts.groupBy("bucket").agg(F.sum(name)).collect():  # BUCKETS rows
            out[bucket] = n
    return out


def target_texts(docs: DataFrame, good: DataFrame, key: str, text: str, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """``text`` of the rows whose id is in column ``_id`` of ``good`` (distinct ids)."""
    words, bits = id_filter(good, "_id", most_bytes)
    held = docs.sparkSession.sparkContext.broadcast(words)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text"), *[p.alias(f"_p{i}") for i, p in enumerate(places(F.col(key), bits))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in batches:
            may = np.ones(batch.num_rows, bool)
            for i in range(2, 2 + HASHES):
                cell = batch.column(i).to_numpy()
                may &= (words[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(may)).select(["_id", "text"])

    id_type = rows.schema["_id"].dataType.simpleString()
    may_be = rows.where("_id is not null and text is not null").mapInArrow(run, f"_id {id_type}, text string")
    return may_be.join(good.hint("merge"), "_id").select("text")


def log_ratio(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray | None:
    """log P(bucket | target) - log P(bucket | raw); nothing without target texts."""
    good = labels.where(F.col(label) == 1).select(F.col(key).alias("_id")).where("_id is not null").distinct()
    good = materialise(good, "good-ids")
    target = _counted(target_texts(docs, good, key, text), "target")
    if not target.any():
        return None
    counts = np.stack([_counted(docs.select(text), "raw"), target])
    chance = (counts + PRIOR) / (counts.sum(axis=1, keepdims=True) + PRIOR * BUCKETS)
    return np.log(chance[1]) - np.log(chance[0])


def weigh(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``key`` and ``log_ratio`` (the log of the importance weight) of every row."""
    ratio = log_ratio(docs, labels, key, text, **more)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if ratio is None:
        return rows.select(F.col("doc_id").alias(key), F.lit(0.0).alias("log_ratio"))
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ratio = WordHasher(signs=True), np.append(shared.value, 0.0)  # place -1 is no feature
        for batch in batches:
            for first, hashes, bounds in hasher.column(batch.column(1)):
                ones, pairs = features(hashes, bounds)
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                sums = np.bincount(text, ratio[ones] + ratio[pairs], len(bounds) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sums)), pa.array(sums, pa.float64())], ["doc_id", "log_ratio"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, log_ratio double").withColumnRenamed("doc_id", key)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, key: str = "doc_id", text: str = "text",
             label: str = "quality", seed: int = SEED, without_target: float = 1.0) -> DataFrame:
    """``key``, ``log_ratio``, ``sample_key`` and ``kept`` of every row; the ``share`` with the largest keys is kept."""
    if share is None:
        share = labels.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0] or without_target
    u = uniform(F.lit(seed), F.col(key)) + F.lit(2.0**-53)
    keyed = weigh(docs, labels, key, text, label=label).withColumn("sample_key", F.col("log_ratio") - F.ln(-F.ln(u)))
    keyed = written(keyed, "keys")
    count = keyed.count()
    if not count:
        return keyed.withColumn("kept", F.lit(True))
    least = order_statistics(keyed, "sample_key", [count - max(1, round(share * count))])[0]
    return keyed.withColumn("kept", F.col("sample_key") >= F.lit(least))
