"""Response lines of a language model, read back into pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameweave.functions.text import response_text


def parsed(lines: DataFrame) -> DataFrame:
    """(custom_id, content) of response lines (line)."""
    return lines.select(F.get_json_object("line", "$.custom_id").alias("custom_id"), response_text(F.col("line")).alias("content"))


def booleans(responses: DataFrame) -> DataFrame:
    """(left_id, answers): for each line of the content whether it holds True."""
    return responses.select(F.col("custom_id").try_cast("long").alias("left_id"), F.transform(F.split("content", "\n"), lambda x: x.contains("True")).alias("answers"))


def conformed(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """The pairs whose answer, by place within the block, is true. Answers beyond the block are ignored."""
    placed = pairs.select("left_id", "right_id", (F.row_number().over(Window.partitionBy("left_id").orderBy("right_id")) - 1).alias("pos"))
    said = answers.select("left_id", F.posexplode("answers").alias("pos", "yes")).where("yes")
    return placed.join(said, ["left_id", "pos"], "left_semi").select("left_id", "right_id")


def pair_ids(responses: DataFrame) -> DataFrame:
    """(left_id, right_id, content) of responses with custom_id left#right; others are left out."""
    ids = F.split("custom_id", "#")
    return responses.select(F.get(ids, F.lit(0)).try_cast("long").alias("left_id"), F.get(ids, F.lit(1)).try_cast("long").alias("right_id"), "content").where("left_id is not null and right_id is not null")


def positive_pairs(responses: DataFrame) -> DataFrame:
    return pair_ids(responses).where(F.col("content").contains("True")).select("left_id", "right_id").distinct()


def seen_keys(responses: DataFrame) -> DataFrame:
    """(left_id): all left records with any response."""
    return pair_ids(responses).select("left_id").distinct()


def confident_pairs(responses: DataFrame, least: float = 0.8) -> DataFrame:
    """(left_id, right_id, score): of each left record the pairs of highest score, ties included, if it is `least` or more. Content that is no number is skipped."""
    scored = pair_ids(responses).withColumn("score", F.btrim("content").try_cast("double")).where(F.col("score") >= least)
    best = Window.partitionBy("left_id").orderBy(F.col("score").desc())
    return scored.withColumn("r", F.rank().over(best)).where("r = 1").select("left_id", "right_id", "score")


def unreadable_scores(responses: DataFrame) -> DataFrame:
    return pair_ids(responses).where(F.btrim("content").try_cast("double").isNull())


def densified(pairs: DataFrame, lefts: int) -> DataFrame:
    """(left_id, block) for all lefts from 0, empty where there is no pair."""
    blocks = pairs.groupBy("left_id").agg(F.sort_array(F.collect_set("right_id")).alias("block"))
    every = pairs.sparkSession.range(lefts).withColumnRenamed("id", "left_id")
    return every.join(blocks, "left_id", "left").select("left_id", F.coalesce("block", F.array().cast("array<bigint>")).alias("block"))


def densified_sizes(sizes: DataFrame, lefts: int) -> DataFrame:
    """(left_id, n) for all lefts from 0: how long the blocks of densified are, from blocking.sizes."""
    every = sizes.sparkSession.range(lefts).withColumnRenamed("id", "left_id")
    return every.join(sizes, "left_id", "left").select("left_id", F.coalesce("n", F.lit(0)).alias("n"))


def restricted(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Response rows whose pair is among the candidates."""
    ids = F.split("custom_id", "#")
    keyed = responses.withColumns({"left_id": F.get(ids, F.lit(0)).try_cast("long"), "right_id": F.get(ids, F.lit(1)).try_cast("long")})
    return keyed.join(pairs.select("left_id", "right_id"), ["left_id", "right_id"], "left_semi")


def tournament_round(responses: DataFrame, pairs: DataFrame, right: DataFrame, left_over: DataFrame) -> DataFrame:
    """(left_id, right_id) of the next round: for each response (custom_id left-chunk) the first candidate whose title stands in it, and the pairs left over."""
    said = responses.select(F.get(F.split("custom_id", "-"), F.lit(0)).try_cast("long").alias("left_id"), "custom_id", "content").where("left_id is not null")
    named = pairs.join(right.select(F.col("rec_id").alias("right_id"), "title"), "right_id").where("title <> ''")
    hit = said.join(named, "left_id").where(F.col("content").contains(F.col("title")))
    first = hit.groupBy("left_id", "custom_id").agg(F.min("right_id").alias("right_id")).select("left_id", "right_id")
    return first.union(left_over.select("left_id", "right_id")).distinct()


def valid_share(responses: DataFrame, pairs: DataFrame, right: DataFrame) -> DataFrame:
    """valid: the share of responses that name a candidate of their block."""
    said = responses.select(F.get(F.split("custom_id", "-"), F.lit(0)).try_cast("long").alias("left_id"), "custom_id", "content")
    named = pairs.join(right.select(F.col("rec_id").alias("right_id"), "title"), "right_id").where("title <> ''")
    hit = said.join(named, (said.left_id == named.left_id) & F.col("content").contains(F.col("title")), "left_semi").withColumn("hit", F.lit(1))
    return said.join(hit.select("custom_id", "hit").distinct(), "custom_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("valid"))


def answers_against_truth(answer: DataFrame, truth: DataFrame) -> DataFrame:
    """precision and recall of one answer text (content), whose i-th line is for truth row pos (pos, match)."""
    said = answer.select(F.posexplode(F.split("content", "\n")).alias("pos", "x")).select("pos", F.col("x").contains("True").alias("yes"))
    met = truth.join(said, "pos", "left").na.fill(False, ["yes"])
    both = F.sum((F.col("yes") & F.col("match")).cast("int"))
    return met.agg((both / F.nullif(F.sum(F.col("yes").cast("int")), F.lit(0))).alias("precision"), (both / F.nullif(F.sum(F.col("match").cast("int")), F.lit(0))).alias("recall"))
