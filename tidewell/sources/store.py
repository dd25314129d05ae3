"""A store of chunk records with one folder per tenant, so that a query reads the folders of its tenants only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = 8  # a tenant's rows are dealt over at most this many files a write


def write_tenants(records: DataFrame, path: str, tenant: str = "tenant", key: str = "id", files: int = FILES, mode: str = "append") -> None:
    """Write records by tenant.  A large tenant is spread over ``files`` tasks, so none writes it alone."""
    dealt = records.repartition(F.col(tenant), F.pmod(F.xxhash64(key), F.lit(files)))
    dealt.write.mode(mode).partitionBy(tenant).parquet(path)


def read_tenants(spark: SparkSession, path: str, only: list | DataFrame | None = None, tenant: str = "tenant") -> DataFrame:
    """Records of the tenants in ``only``: values, or a frame with a column ``tenant``.

    Values become a filter on folders while the query is planned.  A frame is joined; Spark then prunes folders while the
    query runs (dynamic partition pruning), where it expects that to pay.
    """
    rows = spark.read.parquet(path)
    if only is None:
        return rows
    if isinstance(only, DataFrame):
        return rows.join(only.select(tenant).distinct(), tenant)
    return rows.where(F.col(tenant).isin(list(only)))


def folders_read(df: DataFrame) -> int:
    """How many files the scans of a query read, from the metrics of its finished plan (adaptive execution off)."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        files = leaves.apply(i).metrics().get("numFiles")
        total += files.get().value() if files.isDefined() else 0
    return total
