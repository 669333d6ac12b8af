"""Sinks: delimited files, blocks as JSON, request lines, collections, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def unquoted(df: DataFrame, path: str) -> None:
    """TSV without quotes, in compressed files; fields must hold no tabs or line ends."""
    df.write.mode("overwrite").option("compression", "gzip").option("header", True).option("sep", "\t").option("quote", "").option("escapeQuotes", False).csv(path)


def blocks(as_blocks: DataFrame, path: str) -> None:
    """One JSON object per line of left_id and its block, in compressed files."""
    as_blocks.write.mode("overwrite").option("compression", "gzip").json(path)


def block_object(as_blocks: DataFrame, path: str) -> None:
    """One JSON object of left id -> block in the files of a folder, an entry a line: put together in the order of their names, they are the object. They are compressed, as blocks next to each other are often much the same."""
    spark = as_blocks.sparkSession
    entry = F.concat(F.lit('"'), F.col("left_id").cast("string"), F.lit('":'), F.to_json("block"))
    first = as_blocks.agg(F.min("left_id").alias("first")).head()["first"]
    brace = lambda x: spark.range(0, 1, 1, 1).select(F.lit(x).alias("line"))
    if first is None:
        whole = brace("{}")
    else:
        head = as_blocks.where(F.col("left_id") == first).select(F.concat(F.lit("{"), entry).alias("line")).coalesce(1)
        rest = as_blocks.where(F.col("left_id") != first).select(F.concat(F.lit(","), entry).alias("line"))
        whole = head.unionAll(rest).unionAll(brace("}"))
    whole.write.mode("overwrite").option("compression", "gzip").text(path)


def lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(path)


def parts(df: DataFrame, path: str) -> None:
    """Lines with a part number, each part in its own folder, in compressed files."""
    df.select("line", "part").write.mode("overwrite").option("compression", "gzip").partitionBy("part").text(path)


def collection(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def log(df: DataFrame, path: str) -> None:
    """Appends lines (value) with the time before them."""
    df.select(F.concat_ws(" ", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), "value").alias("value")).write.mode("append").text(path)


def characters(text: DataFrame, path: str, column: str = "text") -> None:
    """One line for each character."""
    text.select(F.explode(F.split(column, "")).alias("value")).where("value <> ''").write.mode("overwrite").text(path)
