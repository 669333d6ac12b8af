"""Response files as a stream: each line once, pairs as they arrive, running metrics, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nameweave.operators import evaluate, responses


def response_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(custom_id, content) of JSONL files that appear in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).schema("value string").text(folder).withColumnRenamed("value", "line")
    return responses.parsed(lines)


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each custom_id once within the delay; the state older than it goes."""
    return stream.withColumn("seen", F.current_timestamp()).withWatermark("seen", delay).dropDuplicatesWithinWatermark(["custom_id"])


def running_metrics(stream: DataFrame, matches: DataFrame, pairs_path: str, checkpoint: str, report: Callable[[int, dict], None]) -> StreamingQuery:
    """Writes each new positive pair once, and reports metrics of all so far after each batch.

    The stream's state knows the pairs that were seen, one row for each, so a batch has the new ones alone; they meet the matches, and two counters
    go on from those of the batch before. Nothing that was written is read again. Pairs and counters have a folder for each batch, which a
    batch that is run again overwrites with the same, as state and counters of the batch before it are kept.
    """
    n_matches = matches.count()
    truth = matches.select("left_id", "right_id").distinct()
    counters = f"{pairs_path.rstrip('/')}_counters"
    schema = "n_pairs long, n_found long, batch long"

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        path = f"{pairs_path}/batch={n}"
        df.write.mode("overwrite").parquet(path)
        new = spark.read.schema(df.schema).parquet(path)
        found = new.join(truth.withColumn("hit", F.lit(1)), ["left_id", "right_id"], "left")
        added = found.agg(F.count("*").alias("n_pairs"), F.count("hit").alias("n_found")).select("*", F.lit(n).cast("long").alias("batch"))
        if n:
            before = spark.read.schema(schema).parquet(f"{counters}/batch={n - 1}")
            added = added.unionByName(before).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_found").alias("n_found"), F.max("batch").alias("batch"))
        added.coalesce(1).write.mode("overwrite").parquet(f"{counters}/batch={n}")
        counts = spark.read.schema(schema).parquet(f"{counters}/batch={n}").withColumn("n_matches", F.lit(n_matches).cast("long"))
        report(n, evaluate.scored_counts(counts).first().asDict())

    once = responses.positive_pairs(stream)  # distinct, which a stream keeps state for
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum of events (ts, event_type, value) by type and tumbling or sliding window; works on tables and streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
