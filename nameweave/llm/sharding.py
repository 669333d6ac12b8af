"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 by doc_id. A keyed permutation of these numbers is the shuffle: number i goes to place p(i),
shard p mod shards, slot p div shards. So both can be computed from the row number, and back, without any table, and
shards differ by a row at most. The permutation is a Feistel network over pairs (left, right) with left < A and
right < B, where A*B is the smallest such product with A = ceil(sqrt(N)) that holds N. Numbers that land at or past N
walk on: the network is applied again until one is below N. As A*B - N < A, few rows walk, and none for long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import ordinal, text_key
from nameweave.operators.numbering import numbered
from nameweave.scratch import Table

SHARDS, KEY, ROUNDS = 24, 2024, 6
#: Walks of more steps than this raise; their chance is below 64 ** -64.
STEPS = 64


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _network(p: Column, n: int, key: int, rounds: int) -> Column:
    """The places after one pass through the network, of numbers below A*B."""
    a, b = sides(n)
    # a struct goes through the rounds as an accumulator, else each round would double the expression
    step = lambda s, t: F.struct(
        F.when(t % 2 == 0, F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(key), t, s["r"]), F.lit(a)), F.lit(a))).otherwise(s["l"]).alias("l"),
        F.when(t % 2 == 1, F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(key), t, s["l"]), F.lit(b)), F.lit(b))).otherwise(s["r"]).alias("r"),
    )
    start = F.struct(F.floor(p / F.lit(b)).cast("long").alias("l"), F.pmod(p, F.lit(b)).alias("r"))
    return F.aggregate(F.array(*(F.lit(t) for t in range(rounds))), start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(number: Column, n: int, key: int = KEY, rounds: int = ROUNDS) -> Column:
    """The place of each row number below n, as long; raises if a walk doesn't end."""
    once = _network(number, n, key, rounds)
    steps = F.array_repeat(F.lit(0), min(n, STEPS))
    walk = F.aggregate(steps, once, lambda p, _: F.when(p < n, p).otherwise(_network(p, n, key, rounds)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a cycle walk didn't end")).cast("long"))


def shards(docs: DataFrame, count: int = SHARDS, key: int = KEY) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law "rows": the shards' counts are at most one apart. Null doc_ids come first, null and empty texts are of size 8, and long ones
    count as a whole; rows that share a doc_id are ordered by their text's checksum, size and hash, and equal rows are
    interchangeable. An empty table gives none. Other columns of docs, whatever their names, aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", ordinal(docs).alias("at"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key().alias("text"))
    table = Table(rows, "sizes")
    n = table.count()
    placed = numbered(table.df, ["at", "text_crc32", "size", "text"]).withColumn("place", permuted(F.col("row_number"), max(1, n), key))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(count)).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(count)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
