import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from nameweave import scratch
from nameweave.llm import simhash
from tests.llm.conftest import PLAIN, collected, rows


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(docs):
    """Smallest doc_id reachable, from all pairs of documents."""
    fp = [brute(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((d for (d, _), x in zip(docs, group, strict=True) if x == g and d is not None), default=None) for g in set(group)}
    return [(d, f"{f:016x}", least[g]) for (d, _), f, g in zip(docs, fp, group, strict=True)]


def test_fingerprint():
    for _, text, *_ in rows():
        assert simhash.fingerprint(text) == brute(text)


def test_codes_are_perfect_and_cover():
    for code, n in ((simhash.GOLAY, 2048), (simhash.HAMMING, 8)):
        (offsets, patterns), *_ = simhash.error_patterns(0, code)
        assert (np.diff(offsets) == 1).all() and len(patterns) == n
    rng = random.Random(4)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randrange(3)):
            y ^= 1 << bit
        home = simhash.anchors(np.array([x], np.uint64).view(np.int64), 0)[1]
        replicas = simhash.anchors(np.array([y], np.uint64).view(np.int64), 2)[1].tolist()
        assert len(home) == 1 and home[0] in replicas and len(set(replicas)) == len(replicas)


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(12)} | {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    assert got == want


def test_query(odd, none, clashing):
    want = brute_components([(i, t) for i, t, *_ in rows()])
    got = simhash.near_duplicates(odd)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert simhash.near_duplicates(none).count() == 0
    assert collected(simhash.near_duplicates(clashing)) == collected(got)


def test_large_groups_and_chains(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words)) for i in range(40)]
    for i in range(40, 140):
        w = list(words)
        w[rng.randrange(400)] = f"x{i}"
        docs.append((i, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(repr, brute_components(docs))) == sorted(repr(tuple(r)) for r in got.collect())


def test_stage_keeps_one_of_each_group(odd, none):
    left = simhash.without_near_duplicates(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert 1 in ids and 2 not in ids and 7 in ids and 8 in ids
    assert sum(t == PLAIN for (t,) in left.select("text").collect()) == 1  # of two equal rows of doc_id 1 and a copy, one
    assert simhash.without_near_duplicates(none).count() == 0


def test_rows_without_id_are_apart(spark):
    docs = [(None, PLAIN), (None, PLAIN), (None, "other words stand in here for once"), (4, "x y z"), (4, "p q r s"), (9, "x y z"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(repr, map(tuple, simhash.without_near_duplicates(df).collect()))) == sorted(map(repr, [docs[0], docs[2], docs[3], docs[4], docs[6]]))


def test_stage_with_clashing_names(clashing, odd):
    left = simhash.without_near_duplicates(clashing.selectExpr("*", "1 as __drop_id", "2 as text_key", "3 as component_id"))
    assert left.columns == [*clashing.columns, "__drop_id", "text_key", "component_id"]
    assert left.count() == simhash.without_near_duplicates(odd).count()


def test_replicas_are_not_broadcast(spark):
    """Spark takes the replicas, 126 of a fingerprint, for as many rows as there are fingerprints."""
    fps = spark.range(50).select((F.col("id") * 7919).alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tables_beyond_the_broadcast_size_are_not_broadcast(spark):
    """Spark sizes a table by its compressed file, whatever it holds."""
    rows = spark.range(50)
    for most, broadcast in ((0, False), (1 << 20, True)):
        plan = rows.join(scratch.small(spark.range(20), most), "id")._jdf.queryExecution().executedPlan().toString()
        assert ("Broadcast" in plan) == broadcast
