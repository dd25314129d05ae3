"""Streaming sources, sinks and jobs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import packing, skew
from tidewell.operators.sequences import Rule
from tidewell.session import ROCKSDB, materialise, settings, work_dir
from tidewell.sources.keyed import KeyedTable
from tidewell.streaming.processors import BUCKET_SECONDS, stateful, states, waiting

FILES_PER_BATCH = 64


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a parquet table that is one file or a folder of part files, at most ``files_per_batch`` of them at a time."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch or FILES_PER_BATCH)
    return reader.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")  # a glob stands for a file as well as for a folder


@dataclass
class Run:
    """What a finished stream leaves: its table, its checkpoint, batches, and rows dropped behind the watermark."""

    table: DataFrame
    marks: str
    batches: int
    late: int
    states: DataFrame | None = None  # of a rule, by key: what it would go on from


def run_stream(stream: DataFrame, label: str, marks: str | None = None) -> Run:
    """Run a stream over all data that is there now into a parquet table; exactly once, restartable from ``marks``.

    ``late`` sums the progress reports that Spark keeps (``spark.sql.streaming.numRecentProgressUpdates``, 100 by default).
    """
    spark = stream.sparkSession
    out, marks = work_dir(spark, label), marks or work_dir(spark, f"{label}-checkpoint")
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(
            availableNow=True).start()
    query.awaitTermination()
    reports = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    late = sum(o.get("numRowsDroppedByWatermark", 0) for p in reports for o in p.get("stateOperators", []))
    return Run(spark.read.schema(stream.schema).parquet(out), marks, len(reports), late)


def run_to_table(stream: DataFrame, label: str, marks: str | None = None) -> DataFrame:
    return run_stream(stream, label, marks).table


def run_rule(
    stream: DataFrame, keys: list[str], rule: Rule, time: str, keep_seconds: int | None, label: str, bucket_seconds: int = BUCKET_SECONDS
) -> Run:
    """Run a rule in event-time order; rows that still wait for the watermark at the end are added."""
    run = run_stream(stateful(stream, keys, rule, time, keep_seconds, bucket_seconds), label)
    rest = materialise(waiting(stream, keys, rule, run.marks), f"{label}-waiting")
    run.table = run.table.unionByName(rest.drop("_state"))
    after = rest.where("_state is not null").select(*keys, F.col("_state").alias("body"))
    held = states(stream, keys, run.marks)
    run.states = after.unionByName(skew.equal_join(held, after.select(*keys), keys, "left_anti"))
    return run


def running_counts(stream: DataFrame, key: str, label: str, most: int = 16) -> DataFrame:
    """Running count per key: each batch hands its changed keys to a keyed table, where the latest batch wins."""
    spark = stream.sparkSession
    counts, marks = KeyedTable(spark, work_dir(spark, label), [key], most=most), work_dir(spark, f"{label}-checkpoint")
    changed = stream.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    changed.writeStream.outputMode("update").option("checkpointLocation", marks).foreachBatch(counts.merge).trigger(
        availableNow=True).start().awaitTermination()
    return counts.read()


def _tag(speakers: list[str]) -> str:
    return rf"^\W*({'|'.join(speakers)})\W*\s*:\s*(.*)$"


def dialogue_rule(order: str, piece: str, speakers: list[str]) -> Rule:
    """Lines of a script that arrives in pieces: a turn is released when the next speaker starts.

    A piece is glued to the line left unfinished by the one before and split into lines; all but the last are complete.
    Tags open turns, and counting them tells which turn every line belongs to.  State is the unfinished line with the
    position it began at, and the open turn; ``released`` is a JSON list of [speaker, text, position].
    """
    import re

    tag = re.compile(_tag(speakers), re.IGNORECASE)

    def complete(lines: list[tuple[str, int]], turn: list | None) -> list[list]:
        """The turns that lines belong to, the open one first; lines ahead of any tag belong to none."""
        turns = [turn] if turn else []
        for line, at in lines:
            if head := tag.match(line):
                turns.append([head[1].lower(), head[2], str(at)])
            elif turns and line.strip():
                turns[-1] = [turns[-1][0], f"{turns[-1][1]} {line}", turns[-1][2]]
        return turns

    def run(state, rows):
        held = state or {"buffer": "", "began": None, "open": None}
        out = []
        for text_, at in zip(rows[piece].tolist(), rows[order].tolist(), strict=True):
            began = held["began"] if held["buffer"] else at
            *whole, rest = (held["buffer"] + text_).split("\n")
            lines = [(line, began if i == 0 else at) for i, line in enumerate(whole)]
            *done, last = complete(lines, held["open"]) or [None]
            held = {"buffer": rest, "began": at if whole else began, "open": last}
            out.append(json.dumps(done, ensure_ascii=False))
        return {"released": out}, held

    return Rule(run, "released string", (order,))


def released_turns(released: DataFrame, keys: list[str]) -> DataFrame:
    turns = F.from_json("released", "array<array<string>>")
    return released.select(*keys, F.explode(turns).alias("_t")).select(
        *keys, F.col("_t")[2].cast("bigint").alias("turn"), F.col("_t")[0].alias("speaker"), F.col("_t")[1].alias("text"))


def open_turns(states: DataFrame, keys: list[str], speakers: list[str]) -> DataFrame:
    """What the end of a dialogue stream releases: the open turn and the unfinished line, from the states of its rule."""
    body = F.from_json(F.col("body"), "buffer string, began bigint, open array<string>")
    rest = states.select(*keys, body.alias("b")).select(*keys, "b.*")
    tag = "(?i)" + _tag(speakers)
    own = F.col("buffer").rlike(tag)
    tail = F.when(own | (F.trim("buffer") == ""), "").otherwise(F.concat(F.lit(" "), "buffer"))

    def turn(at, speaker, words):
        return F.struct(at.cast("bigint").alias("turn"), speaker.alias("speaker"), words.alias("text"))

    held = F.when(F.col("open").isNotNull(), turn(F.get("open", 2), F.get("open", 0), F.concat(F.get("open", 1), tail)))
    last = F.when(own, turn(F.col("began"), F.lower(F.regexp_extract("buffer", tag, 1)), F.regexp_extract("buffer", tag, 2)))
    both = rest.select(*keys, F.explode(F.array(held, last)).alias("t")).where(F.col("t").isNotNull())
    return both.select(*keys, "t.turn", "t.speaker", "t.text")


def spoken(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Clean turns and cut long ones into lines."""
    clean = turns.select(*keys, "turn", "speaker", text.strip_markup(F.col("text")).alias("_text")).where(F.col("_text") != "")
    return clean.select(*keys, "turn", "speaker", F.posexplode(packing.spoken_lines(F.col("_text"))).alias("part", "text"))
