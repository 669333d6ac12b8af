import math
import random
import struct
import zlib
from collections import defaultdict

import pytest
import xxhash

from pyspark.sql import functions as F

from nameweave import scratch
from nameweave.llm import mixing, sharding
from nameweave.operators import numbering
from tests.llm.conftest import collected, rows


def spark_hash(*values):
    """Spark's xxhash64 of ints ('i') and longs ('q'), given as (format, value): the hash of each seeds the next."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), h)
    return h - (1 << 64) if h >> 63 else h


def brute_targets(sizes):
    """Shares by weight, with the excess over the limit reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    budget = 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] = left * weight[s] / total
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
        full |= set(over)


def test_targets(spark):
    rng = random.Random(12)
    for k in (1, 2, 3, 7, 20):
        sizes = {f"s{i}": rng.choice([0, 5, rng.randrange(1, 9000), 100]) for i in range(k)} | {None: rng.randrange(1, 50)}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want), (sizes, got, want)


def test_mix_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    rng = random.Random(13)
    docs = [(i, " ".join("w" * rng.randrange(1, 40)), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mixed_sizes(df).collect()
    assert len(got) == 1500 and all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    source, taken, aim = {d: s for d, _, s in docs}, defaultdict(int), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        aim[source[r.doc_id]] = r.target
        assert r.source_size >= r.size
    assert all(abs(taken[s] - aim[s]) <= 80 for s in aim)
    assert collected(mixing.mixed_sizes(df.repartition(7))) == collected(mixing.mixed_sizes(df))


@pytest.mark.parametrize("sorted_rows", [mixing.SORTED, 5])
def test_mix_is_the_queue(spark, monkeypatch, sorted_rows):
    """Against a queue that takes copies one by one in order of virtual time."""
    monkeypatch.setattr(mixing, "SORTED", sorted_rows)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 30)
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    rng = random.Random(21)
    docs = [(rng.choice([i, i, i, None]), " ".join("w" * rng.randrange(0, 30)), rng.choice(["a", "a", "b", "c", None])) for i in range(400)] + [(7, "same row", "b")] * 5
    key = lambda t: spark_text_hash(t)
    entries = defaultdict(int)
    for d, t, s in docs:
        entries[s, -(1 << 63) if d is None else d, key(t), len(t.split())] += 1
    sizes = defaultdict(int)
    for (s, *_, size), n in entries.items():
        sizes[s] += size * n
    target = brute_targets(sizes)
    queue = []
    for s in sizes:
        own = sorted((spark_hash(("i", 17), ("q", d), ("q", k)), d, k, size * n) for (x, d, k, size), n in entries.items() if x == s and size)
        for r in (0, 1):
            total = 0
            for h, d, k, cost in own:
                total += cost
                queue.append((total / target[s] + r * (sizes[s] / target[s]), "" if s is None else "1" + s, h, d, k, r, cost, s))
    left, taken = sum(target.values()), defaultdict(int)
    for *_, d, k, _, cost, s in sorted(queue, key=lambda c: (int(c[0] * 2**40), c[2], c[1], *c[3:6])):
        left -= cost
        if left < -1e-6:
            break
        taken[s, d, k] += 1
    got = mixing.mixed_sizes(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    want = [(d, len(t.split()), taken[s, -(1 << 63) if d is None else d, key(t)] * len(t.split())) for d, t, s in docs]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.size, r.taken)) for r in got.collect())


def test_sources_of_one_document_end_at_one_time_and_are_cut_all_the_same(spark, monkeypatch):
    """All second copies finish at time 1; the range that they fall into is cut by hash."""
    monkeypatch.setattr(mixing, "SORTED", 20)
    cuts, real = [], mixing._cut
    monkeypatch.setattr(mixing, "_cut", lambda *a: cuts.append(real(*a)) or cuts[-1])
    docs = spark.range(3000).selectExpr("id as doc_id", "'five words of one text' as text", "concat('s', id) as source")
    got = mixing.mixed_sizes(docs, weights=(1,)).collect()
    assert sum(r.taken for r in got) == 22_500 and all(r.taken in (5, 10) for r in got)
    assert cuts[0]["n"] > 1000 and cuts[-1]["n"] <= 20


def spark_text_hash(t):
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_mix_rows(odd, none, clashing):
    got = mixing.mixed_sizes(odd)
    assert got.count() == len(rows()) and mixing.mixed_sizes(none).count() == 0
    assert {r.doc_id: r.size for r in got.collect()}[7] == 60_000
    assert collected(mixing.mixed_sizes(clashing)) == collected(got)
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and mixing.mixed(none).count() == 0
    want = defaultdict(int)
    for r in got.collect():
        want[r.doc_id] += r.taken
    have = out.select("doc_id", mixing.words(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r.doc_id: r.n for r in have.collect()} == {d: n for d, n in want.items() if n}


def test_permutation(spark):
    for n in (1, 2, 3, 5, 24, 25, 100, 1000, 4097):
        got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    a, b = (spark.range(1000).select(sharding.permuted(F.col("id"), 1000, key).alias("p")).collect() for key in (1, 2))
    assert a != b and sum(x.p == i for i, x in enumerate(a)) < 20


def brute_place(number, n, key=2024, rounds=6):
    a, b = math.isqrt(n - 1) + 1 if n > 1 else 1, 0
    b = max(1, -(-n // a))
    while True:
        left, right = divmod(number, b)
        for t in range(rounds):
            if t % 2 == 0:
                left = (left + spark_hash(("i", key), ("i", t), ("q", right)) % a) % a
            else:
                right = (right + spark_hash(("i", key), ("i", t), ("q", left)) % b) % b
        number = left * b + right
        if number < n:
            return number


def test_shard_and_slot_can_be_computed(spark):
    """From the row number alone, by a network written anew."""
    docs = [(3 * i - 90, f"text {i}") for i in range(777)]
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for number, (d, _) in enumerate(sorted(docs)):
        place = brute_place(number, len(docs))
        assert got[d] == (place % 24, place // 24)


def test_shards(spark, odd, none, clashing, monkeypatch):
    monkeypatch.setattr(numbering, "RANGE_ROWS", 4)
    got = sharding.shards(odd).collect()
    assert len(got) == len(rows())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[i]) for i in range(24)]
    assert max(counts) - min(counts) <= 1
    text = {i: t for i, t, *_ in rows()}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    assert collected(sharding.shards(clashing)) == collected(sharding.shards(odd.repartition(5)))
    assert sharding.shards(none).count() == 0
