import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from nameweave.sources.versions import Versions

COLUMNS = "id long, v string, e array<float>"


def rows(df):
    return sorted((r.id, r.v) for r in df.collect())


def test_versions_are_read_as_they_were_written(spark, tmp_path):
    c = Versions(spark, str(tmp_path / "c"))
    c.create(spark.createDataFrame([(1, "a", [1.0]), (2, "b", None), (3, "c", [])], COLUMNS))
    changes = spark.createDataFrame([(1, "x", None, 1, "U"), (1, "y", [2.0], 2, "U"), (4, "d", None, 1, "I"), (2, "gone", None, 5, "D"), (None, "none", None, 9, "U")], COLUMNS + ", seq int, op string")
    assert c.upsert(changes, ["seq"], F.col("op") == "D") == 1
    assert rows(c.read()) == [(1, "y"), (3, "c"), (4, "d")] and c.read().columns == ["id", "v", "e"]
    assert c.upsert(spark.createDataFrame([(2, "back", None, 0), (4, "e", None, 0)], COLUMNS + ", seq int"), ["seq"]) == 2
    want = [(1, "y"), (2, "back"), (3, "c"), (4, "e")]
    assert rows(c.read()) == want
    assert c.compact() == 3 and rows(c.read()) == want
    assert rows(c.read(0)) == [(1, "a"), (2, "b"), (3, "c")] and rows(c.read(1)) == [(1, "y"), (3, "c"), (4, "d")] and rows(c.read(2)) == want
    again = Versions(spark, str(tmp_path / "c"))
    again.upsert(spark.createDataFrame([(9, "z", None, 0)], COLUMNS + ", seq int"), ["seq"])
    assert rows(c.read()) == [*want, (9, "z")]
    assert [r.kind for r in c.log()] == ["base", "delta", "delta", "base", "delta"]


def test_a_version_is_written_once(spark, tmp_path):
    c = Versions(spark, str(tmp_path / "c"))
    c.create(spark.createDataFrame([(1, "a", None)], COLUMNS))
    with pytest.raises(AnalysisException):
        c.create(spark.createDataFrame([(2, "b", None)], COLUMNS))
    assert rows(c.read()) == [(1, "a")]
