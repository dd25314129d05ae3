"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tidewell.session import materialise, settings

FOLDS = 5
BATCH_BYTES = 4 << 20  # of one Arrow batch of texts


def small_batches(spark: SparkSession):
    """Inside, tasks hand texts to Python in small Arrow batches: both sides buffer a batch, and an executor runs several."""
    return settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder with small Arrow batches and read it back."""
    with small_batches(df.sparkSession):
        return materialise(df, label)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of a class of this package, by value: executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(value: Broadcast) -> object:
    return pickle.loads(value.value)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo five; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)), F.lit(-1)).cast("int")


def map_rows(df: DataFrame, schema: str | StructType, work: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Run ``work`` once per partition: it gets an iterator of row tuples and yields tuples of ``schema``.

    Rows come in Arrow batches and leave in batches of at most 2,000 rows, so a worker holds one batch of texts at a time.
    """
    fields = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield from zip(*[c.to_pylist() for c in part.columns])

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in work(rows(batches)):
            out.append(row)
            if len(out) >= 2_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return df.mapInArrow(run, fields)


def as_digest(items: Column) -> Column:
    """Lower-case hex SHA-256 of an array of texts, joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)
