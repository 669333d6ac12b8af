import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from nameweave.llm import periodic
from tests.llm.conftest import collected


def brute(words):
    """All runs by comparing each stretch's words for each period."""
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p), p)  # the smallest period comes first
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


def expected(doc_id, text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_texts_by_all_stretches(letters):
    r = random.Random(letters)
    texts = []
    for _ in range(300):
        n = r.choice([0, 1, 3, 5, 6, 7, 8, 20, 60, 150])
        words = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randrange(3)):  # plant stretches with a period, some within each other
            p, at = r.randrange(1, 12), r.randrange(n + 1)
            words[at:at] = (words[at : at + p] or [0]) * r.randrange(2, 8)
        texts.append(words)
    got = periodic.runs_of([np.array(t, dtype=np.int64) for t in texts])
    assert [sorted(g) for g in got] == [brute(t) for t in texts]


def test_runs_that_touch_and_lie_within_others():
    for t in ("aaaaaa" "bbbbbb", "ab" * 5 + "a", "aab" * 4, ("aaaaaab" * 5)[1:], "abababababcabababababc" * 4, "a" * 5, "abcabcabcab", "abcabcabcabc"):
        words = [ord(c) for c in t]
        assert sorted(periodic.runs_of([np.array(words)])[0]) == brute(words), t
    assert periodic.runs_of([]) == [] and periodic.runs_of([np.array([], dtype=np.int64)]) == [[]]


def test_digests_of_odd_and_given_documents(spark, odd, clashing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000]
    rows += [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 6000]
    rows += [(i, " ".join(random.Random(i).choices("ab", k=40))) for i in range(1000, 1200)] + [(None, "b b b b b b b"), (12, "x\x1cy\x85z  " * 9)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert collected(got.rdd.map(tuple).toDF(got.schema)) == sorted(repr(r) for r in spark.createDataFrame([expected(*r) for r in rows], got.schema).collect())
    assert any(r.n_runs for r in got.collect())
    assert collected(periodic.periodic_runs(clashing)) == collected(periodic.periodic_runs(odd))


def test_general_operator_and_empty_table(spark, none):
    df = spark.createDataFrame([(1, "go on  on on on\ton on stop"), (2, None), (None, "é é é é é é")], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periodic.run_lengths(df).collect()}
    assert got == {1: ("go on stop", [(1, 6, 1)]), 2: ("", []), None: ("é", [(0, 6, 1)])}
    assert periodic.run_lengths(none).collect() == [] and periodic.periodic_runs(none).collect() == []


def test_long_texts_end_soon():
    """A word 300,000 times, a long period, and two common words: as n log n compares."""
    import time

    r = random.Random(5)
    texts = [np.zeros(300_000, dtype=np.int64), np.tile(np.arange(50_000), 5), np.array([r.randrange(2) for _ in range(100_000)])]
    began = time.time()
    got = periodic.runs_of(texts)
    assert got[0] == [(0, 300_000, 1)] and got[1] == [(0, 250_000, 50_000)] and len(got[2]) > 1000
    assert time.time() - began < 60
