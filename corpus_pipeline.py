"""From raw documents to a training mixture: five stages, each written as Parquet before the next one reads it.

Toxic documents go; one document of each group of near copies stays; documents that hold benchmark passages go; secrets are
masked; sources are mixed to their target shares.  Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, mixing, neardup, secrets, toxicity
from tidewell.llm.common import BATCH_BYTES
from tidewell.session import materialise


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # whole texts pass through Python here and in later stages: small Arrow batches for the rest of this session
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    length = F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))
    return masked.withColumn("n_chars", length)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic_texts),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
]
ORACLE_SQL = None  # SQL cannot express the classifier


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
