"""A neighbour index of centroid cells: an inverted file that is trained, stored and probed.

k-means on a sample gives centroids; each row of a collection belongs to the cell of the nearest one. A query is compared with the rows of the `probes` cells
that are next to it; how many that takes for the recall that is wanted is measured when the index is built, on a sample of rows against all rows. With exact, a second round adds every cell that can still hold a nearer row: by the triangle inequality one whose
centroid is no further from the query than the k-th distance found so far plus the cell's radius. So exact results take fewer compares than all
with all, and the other ones far fewer.

The index is two tables in a folder: the centroids, with the rows and the radius of their cells, and the rows, in blocks of about BLOCK of a
cell. Centroids, CELLS at most, go along with tasks; rows and queries are only dealt by pieces of cells (vectors.nearest_in_cells), so a query is not repeated for each cell that it probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nameweave.operators.vectors import BLOCK, nearest, nearest_in_cells
from nameweave.scratch import Table

#: Vectors that centroids are trained on at most, chosen by a hash of their id, and cells at most.
SAMPLE, CELLS = 50_000, 4096
#: Queries at most, chosen likewise, that the number of probes is measured with, and the recall at NEIGHBOURS that it is to reach on them.
MEASURED, NEIGHBOURS, RECALL = 500, 10, 0.95


def _known(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where(F.col(key).isNotNull() & F.col("embedding").isNotNull())


def centroids(collection: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """A row for each cell; by default as many as the square root of the rows, up to CELLS. Every run gives the same for the same rows."""
    rows = _known(collection, "id")
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = Table(some.repartitionByRange(8, "id").sortWithinPartitions("id"), "training_vectors").df
    some = some.select(array_to_vector("embedding").alias("features"))
    k = cells or max(1, min(CELLS, round(n**0.5)))
    if k < 2:
        first = some.head()
        return np.array([first.features.toArray()]) if first else np.zeros((0, 0))
    return np.array(KMeans(k=k, maxIter=rounds, seed=seed, initMode="random").fit(some).clusterCenters())


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centre."""
    return np.maximum((vectors * vectors).sum(1)[:, None] - 2 * vectors @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values.astype(np.int32)))


def in_cells(rows: DataFrame, key: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(key, embedding, cell, away, turn): each row with each of the `probes` cells next to it, how far their centroids are, and which of them each is, from 1."""
    kind = rows.schema[key].dataType
    probes = min(probes, len(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not probes:
                continue
            far = _distances(_vectors(b.column(1)), centres)
            cell = np.argsort(far, axis=1, kind="stable")[:, :probes]
            away = np.sqrt(np.take_along_axis(far, cell, 1)).ravel()
            at = pa.array(np.repeat(np.arange(b.num_rows), probes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell.ravel().astype(np.int32)), pa.array(away), pa.array(np.tile(np.arange(1, probes + 1, dtype=np.int32), b.num_rows))], names=[key, "embedding", "cell", "away", "turn"])

    return _known(rows, key).mapInArrow(assign, f"{key} {kind.simpleString()}, embedding array<double>, cell int, away double, turn int")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """(cell, keys, vectors): the rows of each cell in blocks of about BLOCK."""
    n = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(F.broadcast(n), "cell")  # a row for each cell, CELLS at most
    packed = dealt.groupBy("cell", F.pmod(F.xxhash64(key), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct(key, "embedding")).alias("v"))
    return packed.select("cell", F.col(f"v.{key}").alias("keys"), F.col("v.embedding").alias("vectors"))


def _probes_for(rows: DataFrame, centres: np.ndarray, recall: float) -> tuple[int, float]:
    """(probes, recall): the fewest probes that find so many of the true neighbours of sampled rows, and how many that are."""
    n = rows.count()
    share = min(1.0, MEASURED / max(1, n))
    some = rows.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    q = Table(some.select(F.col("id").alias("query_id"), "embedding"), "measured_queries").df
    true = nearest(q, rows, NEIGHBOURS, True).select("query_id", "id")
    of = true.join(rows.select("id", "cell"), "id")
    turns = in_cells(q, "query_id", centres, max(1, len(centres))).select("query_id", "cell", "turn")
    found = {r.turn: r.n for r in of.join(turns, ["query_id", "cell"]).groupBy("turn").agg(F.count("*").alias("n")).collect()}  # a row for each cell at most
    total, so_far = sum(found.values()), 0
    for turn in sorted(found):
        so_far += found[turn]
        if so_far >= recall * total:
            return turn, so_far / total
    return max(1, len(centres)), 1.0


class Index:
    """An index at a path that all executors can read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # CELLS at most
        self.centres = np.array([r.centre for r in cells]) if cells else np.zeros((0, 0))
        self.radius, self.rows = np.array([r.radius for r in cells]), np.array([r.n for r in cells])
        self.probes, self.recall = spark.read.parquet(f"{path}/probes").select("probes", "recall").head()

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @classmethod
    def write(cls, collection: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> Index:
        """Trains, measures and stores an index of a collection (id, embedding); rows without either are left out."""
        spark = collection.sparkSession
        centres = centroids(collection, cells, sample)
        of = Table(in_cells(collection, "id", centres), "rows_in_cells")
        stats = {r.cell: r for r in of.df.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
        rows = [(i, c.tolist(), *((stats[i].n, stats[i].radius) if i in stats else (0, 0.0))) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>, n long, radius double").coalesce(1).write.parquet(f"{path}/cells")
        _blocks(of.df.select("id", "embedding", "cell"), "id").write.parquet(f"{path}/rows")
        spark.createDataFrame([_probes_for(of.df, centres, recall)], "probes int, recall double").coalesce(1).write.parquet(f"{path}/probes")
        of.drop()
        return cls(spark, path)

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, embedding, cell, away) for each cell to compare a query with."""
        return in_cells(queries, "query_id", self.centres, probes)

    def compares(self, queries: DataFrame, probes: int) -> int:
        """How many distances a search takes."""
        asked = self.probed(queries, probes).groupBy("cell").agg(F.count("*").alias("n")).collect()
        return sum(r.n * int(self.rows[r.cell]) for r in asked)

    def _found(self, asked: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """The k rows next to each query (query_id, embedding, cells) in its cells; a query's vector isn't repeated for each of them."""
        rows = self.blocks.select("cell", F.explode(F.arrays_zip("keys", "vectors")).alias("v")).select(F.col("v.keys").alias("id"), F.col("v.vectors").alias("embedding"), "cell")
        return nearest_in_cells(asked, rows, {i: int(n) for i, n in enumerate(self.rows) if n}, k, exclude_self)

    def _asked(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, embedding, cells): each query with the `probes` cells next to it."""
        centres, kind = self.centres, queries.schema["query_id"].dataType
        probes = min(probes, len(centres))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not probes:
                    continue
                cell = np.argsort(_distances(_vectors(b.column(1)), centres), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(cell.ravel(), np.full(b.num_rows, probes))], names=["query_id", "embedding", "cells"])

        return _known(queries, "query_id").mapInArrow(assign, f"query_id {kind.simpleString()}, embedding array<double>, cells array<int>")

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, exclude_self: bool = False) -> DataFrame:
        """(query_id, rank, id, distance): the k rows next to each query (query_id, embedding), of the cells probed, or with exact of all."""
        probes = self.probes if probes is None else probes
        near = self._found(Table(self._asked(queries, probes), "probed_cells").df, k, exclude_self)
        if not exact:
            return near
        near = Table(near, "first_found").df
        kth = near.where(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("kth"))
        rest = _known(queries, "query_id").join(kth, "query_id", "left").select("query_id", "embedding", "kth")
        more = self._found(Table(self._other_cells(rest, probes), "other_cells").df, k, exclude_self)
        best = F.struct("distance", "id")
        both = near.unionByName(more).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k).alias("b"))
        return both.select("query_id", F.posexplode("b").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.id", "x.distance")

    def _other_cells(self, rows: DataFrame, probes: int) -> DataFrame:
        """(query_id, embedding, cells): the cells beyond the first `probes` that can hold a row nearer than kth, or any if a query has fewer than k rows so far."""
        centres, radius, kind = self.centres, self.radius, rows.schema["query_id"].dataType
        arrow = to_arrow_type(kind)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(centres):
                    continue
                far = _distances(_vectors(b.column(1)), centres)
                seen = np.argsort(far, axis=1, kind="stable")[:, :probes]
                far = np.sqrt(far)
                kth = np.array([np.inf if x is None else x for x in b.column(2).to_pylist()])
                can = far - radius[None, :] <= kth[:, None] + 1e-6 * (1 + far)
                np.put_along_axis(can, seen, False, 1)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow), b.column(1), _lists(np.nonzero(can)[1], can.sum(1))], names=["query_id", "embedding", "cells"])

        return rows.mapInArrow(choose, f"query_id {kind.simpleString()}, embedding array<double>, cells array<int>").where(F.size("cells") > 0)
