"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tested with."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for what is started inside; dots are written as double underscores."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


BATCH_BYTES = 4 << 20  # of one Arrow batch of texts


def small_batches(spark: SparkSession):
    """Inside, tasks hand texts to Python in small Arrow batches: both sides buffer a batch, and an executor runs several."""
    return settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES))


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder for one intermediate table, under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; there is no machine-local stand-in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
