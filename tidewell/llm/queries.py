"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import (
    decontaminate, filter_audit, mixing, nearest, neardup, pii, prefix_trie, resample, secrets, suffix_tree, toxicity, urls, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_personal_data")
def op3(spark, folder):
    return pii.report(table(spark, folder, "documents"))


@query("op5_decontamination")
def op5(spark, folder):
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_url_verdicts", urls.oracle())
def op7(spark, folder):
    return urls.judge(table(spark, folder, "pages"), urls.default_rules(spark))


@query("op8_poisson_mix", mixing.oracle())
def op8(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query("op9_secrets")
def op9(spark, folder):
    return secrets.report(table(spark, folder, "documents"))


@query("op10_near_duplicates", neardup.oracle())
def op10(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"), words=2)


@query("op1_toxicity")
def op1(spark, folder):
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_language_model")
def op4(spark, folder):
    return suffix_tree.score(table(spark, folder, "documents"))


@query("op6_nearest_neighbours")
def op6(spark, folder):
    return nearest.search(table(spark, folder, "embeddings"))


@query("op2_quality_resampling")
def op2(spark, folder):
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_prefix_trie", prefix_trie.oracle())
def op11(spark, folder):
    return prefix_trie.report(table(spark, folder, "conversations"))


@query("op12_filter_audit", filter_audit.oracle())
def op12(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_warc_archives", warc.oracle())
def op13(spark, folder):
    return warc.report(table(spark, folder, "pages")).drop("archive", "offset", "length")
