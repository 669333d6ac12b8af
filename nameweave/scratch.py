"""Cutting lineage with tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of its rows, as measured, up to which a table may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset: a temporary folder in local mode, else a folder in the warehouse."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
            base = tempfile.mkdtemp(prefix="nameweave-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        _roots[app] = f"{base.rstrip('/')}/nameweave-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, _roots[app])
    return _roots[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the cluster's owner clears its shared folder
        pass


#: Rows of a file, for tables whose number of rows is known beforehand, and the least number of files.
FILE_ROWS, LEAST_FILES = 20_000, 8


class Table:
    """A table written once to the shared folder. df reads it; drop() deletes it when nothing will read it again.

    rows is about how many rows it will have at most. With it, partitions that would hold next to nothing are written
    together, as each file costs the file system and the processes that write it.
    """

    def __init__(self, df: DataFrame, label: str, compression: str = "zstd", rows: int | None = None):
        self.spark = df.sparkSession
        if rows is not None:
            df = df.coalesce(max(LEAST_FILES, rows // FILE_ROWS))
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        _delete(self.spark, self.path)


def written(df: DataFrame, label: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    return Table(df, label, compression, rows).df


def _width(name: str, kind: T.DataType) -> Column:
    """The bytes of one value in a row, about: 8 for a number, and what a text or an array holds besides."""
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        held = F.octet_length(value)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        held = F.octet_length(F.array_join(value, "")) + 16 * F.size(value)
    elif isinstance(kind, T.ArrayType):
        held = 8 * F.size(value)
    elif isinstance(kind, (T.StructType, T.MapType)):
        held = F.octet_length(F.to_json(value))
    else:
        held = F.lit(0)
    return F.greatest(F.coalesce(held, F.lit(0)), F.lit(0)).cast("long") + 8


def size_of(df: DataFrame) -> int:
    """The bytes of all rows of df in a hash table, by one pass over them."""
    widths = [_width(f.name, f.dataType) for f in df.schema]
    return df.agg(F.sum(reduce(lambda a, b: a + b, widths, F.lit(24))).alias("n")).head()["n"] or 0


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint that joins shuffle it. Spark sizes a table by its files and the types of its columns, so what an explode, Python or a well compressed file makes of it may be broadcast though it is many times as large."""
    return df.hint("merge")


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if its rows measure at most `most` bytes (BROADCAST_BYTES by default); else with one that joins shuffle it."""
    return F.broadcast(df) if size_of(df) <= (BROADCAST_BYTES if most is None else most) else shuffled(df)
