"""A collection in versions: a base table and tables of changes, with a log, so that a small change doesn't rewrite all.

An upsert writes its rows to a folder of their own and then a row of the log, which makes the new version. A version is read as the last base before it,
less the ids that changes since then touch, and the last state of each of these ids. compact() writes what the latest version holds as a
new base; older versions stay readable. Two writers of one version: the second finds its log row taken and fails, with nothing lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nameweave.scratch import small

_LOG = "kind string, folder string, version int"


class Versions:
    """A collection with a column `id`, in a folder that all executors can read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> list:
        """The versions' rows (kind, folder, version), in order; one for each write there was."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return []
        return sorted(self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect(), key=lambda r: r.version)

    def _write(self, rows: DataFrame, kind: str, version: int) -> int:
        folder = f"{kind}-{version}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{folder}")
        one = self.spark.createDataFrame([(kind, folder)], "kind string, folder string")
        one.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/log/version={version}")
        return version

    @staticmethod
    def last_states(changes: DataFrame, order: Sequence[str], deleted: Column | None = None) -> DataFrame:
        """One row for each id, its last by the order, with __deleted. Rows without an id are left out; a hot id is folded before it is shuffled."""
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        rows = changes.where("id is not null").withColumn("__deleted", gone)
        whole = F.struct(*(F.col(c) for c in rows.columns))
        return rows.groupBy("id").agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*")

    def create(self, rows: DataFrame) -> int:
        return self._write(rows, "base", 0)

    def upsert(self, changes: DataFrame, order: Sequence[str], deleted: Column | None = None) -> int:
        """Later rows in place of earlier ones of the same id; where `deleted` holds for an id's last row, the id goes."""
        log = self.log()
        states = self.last_states(changes, order, deleted)
        columns = self.spark.read.parquet(f"{self.path}/{log[0].folder}").columns
        return self._write(states.select(*columns, "__deleted"), "delta", log[-1].version + 1)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest."""
        log = [r for r in self.log() if version is None or r.version <= version]
        base = max(r.version for r in log if r.kind == "base")
        rows = self.spark.read.parquet(f"{self.path}/{next(r.folder for r in log if r.version == base)}")
        deltas = [self.spark.read.parquet(f"{self.path}/{r.folder}").withColumn("__version", F.lit(r.version)) for r in log if r.version > base]
        if not deltas:
            return rows
        changes = deltas[0]
        for d in deltas[1:]:
            changes = changes.unionByName(d)
        last = changes.groupBy("id").agg(F.max_by(F.struct(*(F.col(c) for c in changes.columns)), "__version").alias("r")).select("r.*")
        kept = rows.join(small(changes.select("id").distinct()), "id", "left_anti")
        return kept.select(*rows.columns).unionByName(last.where("not __deleted").select(*rows.columns))

    def compact(self) -> int:
        """A new version with the same rows, as a base."""
        return self._write(self.read(), "base", self.log()[-1].version + 1)
