import numpy as np
import pytest
from pyspark.sql import functions as F

from nameweave.operators import cells, vectors

SF = "/root/testdata/sf0.1"


def found(df):
    return sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in df.collect())


@pytest.fixture
def points(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 8)) * 6
    rows = [(i, (centres[i % 12] + r.normal(size=8)).tolist()) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 640)] + [(None, [0.0] * 8), (700, None)]  # ties, no id, no vector
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def test_exact_and_probed(spark, points, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)
    index = cells.Index.write(points, str(tmp_path / "i"), cells=12)
    assert index.rows.sum() == 640 and index.blocks.select(F.sum(F.size("keys"))).head()[0] == 640
    q = points.where("id % 7 = 0").select(F.col("id").alias("query_id"), "embedding")
    known = points.where("id is not null")
    for k, own in ((5, True), (3, False)):
        want = found(vectors.nearest(q, known, k, own))
        assert found(index.nearest(q, k, probes=1, exact=True, exclude_self=own)) == want
        assert found(index.nearest(q, k, probes=12, exclude_self=own)) == want
    assert index.compares(q, 2) < 640 * q.count() / 2
    again = cells.Index(spark, index.path)  # opened again
    assert found(again.nearest(q, 3, probes=2)) == found(index.nearest(q, 3, probes=2))


def test_fewer_rows_than_asked_for(spark, points, tmp_path):
    few = points.where("id < 4")
    q = few.select(F.col("id").alias("query_id"), "embedding")
    index = cells.Index.write(few, str(tmp_path / "few"), cells=3)
    assert found(index.nearest(q, 10, probes=1, exact=True)) == found(vectors.nearest(q, few, 10))
    none = cells.Index.write(points.where("id < 0"), str(tmp_path / "none"))
    assert none.nearest(q, 3, exact=True).collect() == []
    one = cells.Index.write(points.where("id = 1"), str(tmp_path / "one"))
    assert [r.id for r in one.nearest(q.where("query_id = 2"), 3).collect()] == [1]


def test_recall_over_given_embeddings(spark, tmp_path):
    """At 10 neighbours against the exact path, and with how few compares."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding is not null").select(F.col("vec_id").alias("id"), "embedding")
    index = cells.Index.write(rows, str(tmp_path / "e"))
    q = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = {(r.query_id, r.id) for r in vectors.nearest(q, rows, 10, True).collect()}
    got = {(r.query_id, r.id) for r in index.nearest(q, 10, exclude_self=True).collect()}
    share = index.compares(q, index.probes) / (q.count() * rows.count())
    print("probes", index.probes, "of", len(index.rows), "recall", len(want & got) / len(want), "share of compares", share)
    assert len(want & got) >= 0.9 * len(want) and share < 0.9


def test_a_query_is_not_repeated_for_each_cell(spark, points, tmp_path, monkeypatch):
    """In small pieces, parts and tiles too, with a cell in several pieces, whole results as before."""
    monkeypatch.setattr(vectors, "PIECE", 50)
    monkeypatch.setattr(vectors, "TILE", (7, 9))
    rows = {}
    table = cells.Table
    monkeypatch.setattr(cells, "Table", lambda df, label: rows.setdefault(label, table(df, label)))
    index = cells.Index.write(points, str(tmp_path / "p"), cells=12)
    q = points.where("id % 5 = 0").select(F.col("id").alias("query_id"), "embedding")
    known = points.where("id is not null")
    assert found(index.nearest(q, 4, probes=2, exact=True, exclude_self=True)) == found(vectors.nearest(q, known, 4, True))
    assert rows["probed_cells"].count() == q.where("embedding is not null").count()
