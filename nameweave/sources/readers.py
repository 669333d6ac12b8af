"""Sources: delimited files with embedded JSON, blocks, responses, embeddings, collections, trackers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from nameweave.operators.numbering import numbered_as_read


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


LEXICON = StructType([*_strings("id"), StructField("lon", DoubleType()), *_strings("geo_id", "geowkt"), StructField("lat", DoubleType()), *_strings("title", "geo_source", "title_source", "name_parts")])
PHONETIC = StructType([*_strings("id", "title", "lang", "phoneme", "personAltLabel", "personDescription", "birth", "death"), StructField("age", LongType())])
MATCHES = StructType([StructField("left_id", LongType()), StructField("right_id", LongType())])


def delimited(spark: SparkSession, path: str | Sequence[str], sep: str = ",", schema: StructType | None = None, header: bool = True) -> DataFrame:
    """A CSV or TSV file, a folder, or a list of them. Quotes inside quotes are doubled, fields may hold line ends. Without a schema all columns are strings."""
    r = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (r.schema(schema) if schema else r).csv(path if isinstance(path, str) else list(path))


def unquoted(spark: SparkSession, path: str) -> DataFrame:
    """A TSV file in which quotes are ordinary characters."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def numbered(records: DataFrame) -> DataFrame:
    """Records with rec_id by place in their files, written once; the number is their identity from then on."""
    return numbered_as_read(records, "rec_id")


def record_pair(spark: SparkSession, left: str, right: str, matches: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return delimited(spark, left), delimited(spark, right), delimited(spark, matches, "\t")


def block_lists(spark: SparkSession, path: str) -> DataFrame:
    """(left_id, block) of a JSON object of left id -> array of right ids, a block's ids each once.

    If each line holds whole entries, as those of writers.block_object do, lines are read by many tasks; any other object is read whole.
    """
    body = F.btrim("value", F.lit("{}, \t\r"))
    whole_entries = (body == "") | (body.startswith('"') & body.endswith("]"))
    by_line = spark.read.text(path).where(~whole_entries).isEmpty()
    text = F.concat(F.lit("{"), body, F.lit("}")) if by_line else F.col("value")
    of = spark.read.text(path, wholetext=not by_line).select(F.explode(F.from_json(text, "map<string,array<bigint>>")).alias("left", "block"))
    return of.select(F.col("left").cast("long").alias("left_id"), F.array_distinct("block").alias("block"))


def blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, left_keys) of a JSON file of left id -> array of right ids."""
    of = block_lists(spark, path)
    return of.select("left_id", F.explode("block").alias("right_id")).distinct(), of.select("left_id")


def block_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of writers.blocks, which has one object for each left id, so files of any size are read by many tasks and a pair is repeated within its line alone."""
    of = spark.read.schema("left_id bigint, block array<bigint>").json(path)
    return of.select("left_id", F.explode(F.array_distinct("block")).alias("right_id")), of.select("left_id")


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(line) of text or JSONL files."""
    return spark.read.text(path if isinstance(path, str) else list(path)).withColumnRenamed("value", "line")


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, embedding) of a CSV file whose vectors are JSON arrays."""
    return delimited(spark, path).select("id", "title", F.from_json("embedding", "array<float>").alias("embedding"))


def collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")
