"""A table by key that is kept up to date by batches of changes, without rewriting it for each of them.

The folder holds base tables and change files, each under the number of the batch it reaches up to.  A read merges the latest
complete base with the changes after it: the row of the latest batch wins, or ``add`` columns are summed.  When ``most`` changes
have gathered they become the next base, and what it replaces is removed, so the number of files stays bounded.
A batch that comes again writes its own folder again, or nothing if a base holds it already: replays change nothing.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHANGES = 16


class KeyedTable:
    """``keys`` identify a row; ``add`` names columns whose changes are added up, without any the latest row wins."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], add: list[str] | None = None, most: int = MOST_CHANGES) -> None:
        self.spark, self.path, self.keys, self.add, self.most = spark, path, keys, add or [], most

    def _folders(self) -> tuple[int, dict[int, str], list[str]]:
        """The number of the latest complete base (-1 without any), the changes after it, and folders it has replaced."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"base": [], "change": []}
        for status in files.listStatus(path) if files.exists(path) else []:
            name = status.getPath().getName()
            if m := re.fullmatch(r"(base|change)-(\d+)", name):
                if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                    found[m[1]].append(int(m[2]))
        base = max(found["base"], default=-1)
        changes = {n: self._at("change", n) for n in sorted(found["change"]) if n > base}
        return base, changes, [self._at(k, n) for k in found for n in found[k] if n < base or k == "change" and n == base]

    def _at(self, kind: str, number: int) -> str:
        return os.path.join(self.path, f"{kind}-{number}")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take the changes of a batch: at most one row per key where the latest row wins.  For ``foreachBatch``."""
        base, changes, _ = self._folders()
        if number <= base:
            return
        if self.add:
            batch = batch.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.add])
        batch.write.mode("overwrite").parquet(self._at("change", number))
        if len(changes | {number: ""}) >= self.most:
            self.compact()

    def read(self) -> DataFrame:
        base, changes, _ = self._folders()
        parts = ([(base, self._at("base", base))] if base >= 0 else []) + list(changes.items())
        if not parts:
            raise ValueError(f"no batch was written to {self.path}")
        frames = [self.spark.read.parquet(path).withColumn("_batch", F.lit(n)) for n, path in parts]
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        values = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        if self.add:
            return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.add])
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
        return last.select(*self.keys, "_row.*")

    def compact(self) -> None:
        """Write the next base and remove what it replaces; a base without its success mark is never read."""
        _, changes, _ = self._folders()
        if not changes:
            return
        self.read().write.mode("overwrite").parquet(self._at("base", max(changes)))
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for old in self._folders()[2]:
            files.delete(hadoop.Path(old), True)
