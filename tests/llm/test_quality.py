import math
import random
from pathlib import Path

import numpy as np
import pytest

from nameweave.llm import quality
from tests.llm.conftest import collected, rows

SF = Path("/root/testdata/sf0.01")


def test_estimation_finds_the_accuracies():
    rng = random.Random(11)
    counts, good_of = {}, {}
    rates = [0.95, 0.9, 0.9, 0.8, 0.8, 0.7, 0.9, 0.9]
    for _ in range(20_000):
        good = rng.random() < 0.8
        v = tuple(-1 if rng.random() < 0.3 else int(good) if rng.random() < r else 1 - good for r in rates)
        counts[v] = counts.get(v, 0) + 1
        good_of.setdefault(v, []).append(good)
    post = quality.fit_votes(counts)
    right = sum(sum(g == (post[v] > 0.5) for g in gs) for v, gs in good_of.items())
    best = sum(max(sum(gs), len(gs) - sum(gs)) for gs in good_of.values())
    assert right / best > 0.98
    assert quality.fit_votes({}) == {}


def test_estimation_against_brute_force():
    """The same posteriors as from one document after another, without any arrays."""
    rng = random.Random(5)
    docs = []
    for _ in range(400):
        good = rng.random() < 0.7
        docs.append(tuple(-1 if rng.random() < 0.2 else int(good) if rng.random() < 0.85 else 1 - good for _ in quality.LABELLERS))
    patterns = {v: docs.count(v) for v in docs}
    got = quality.fit_votes(patterns, 30)
    post = [(1 + v.count(1)) / (v.count(1) + 3 * v.count(0) + 2) for v in docs]
    for _ in range(30):
        rate = {}
        for k in range(len(quality.LABELLERS)):
            for c in (0, 1):
                n = [0.5 + sum(p if c else 1 - p for v, p in zip(docs, post, strict=True) if v[k] == x) for x in (0, 1)]
                for x in (0, 1):
                    rate[k, c, x] = n[x] / sum(n)
        prior = [(sum(p if c else 1 - p for p in post) + 1) / (len(docs) + 2) for c in (0, 1)]
        both = []
        for v in docs:
            s = [prior[c] * math.prod(rate[k, c, x] for k, x in enumerate(v) if x >= 0) for c in (0, 1)]
            both.append(s[1] / sum(s))
        done = max(abs(a - b) for a, b in zip(both, post, strict=True)) < 1e-9
        post = post if done else both
        if done:
            break
    assert all(abs(got[v] - p) < 1e-6 for v, p in zip(docs, post, strict=True))


def test_scorer_knows_words_that_no_labeller_sees():
    """Texts on which all labellers vote alike get different scores by their words."""
    texts = [(f"the good {w} of the house and a day to be with us in it for all", y) for w, y in (("alpha", 1.0), ("beta", 0.0)) for _ in range(30)]
    m = [quality.measures(t) for t, _ in texts]
    assert len({quality.votes(*x[:2]) for x in m}) == 1
    w = quality.train([quality.hashed(*x) for x in m], np.array([y for _, y in texts]))
    score = lambda t: sum(w[i] * c for i, c in quality.hashed(*quality.measures(t)).items())
    assert score(texts[0][0]) > 0.5 > -0.5 > score(texts[-1][0])


def test_a_repeated_row_is_one_of_the_sample(spark):
    docs = [(i, f"text {i} of the sample and so on") for i in range(50)] + [(99, "one row that is there again and again")] * 500
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = quality.classified(df, 10_000)
    assert kept.count() == 550 and kept.where("doc_id = 99").select("score").distinct().count() == 1


def test_repeats_leave_the_sample_as_it_is(spark):
    docs = [(i, f"text {i} of the sample and so on") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("text")
    many = df.union(spark.range(40_000).selectExpr("'one row that is there again and again' as text"))
    assert quality.chosen_texts(many, 6000).count() == 81
    some = quality.chosen_texts(many, 40).collect()
    assert 25 <= len(some) <= 55 and sorted(some) == sorted(quality.chosen_texts(many.distinct(), 40).collect())


def test_scorer_by_plain_gradients():
    """Weights and probabilities as dense matrices and loops give them."""
    rows = [{0: 1.0, 3: 0.5, 7: 2.0}, {0: 1.0, 3: 1.5}, {0: 1.0, 9: 1.0}, {0: 1.0, 7: 1.0, 9: 0.25}]
    y = np.array([0.9, 0.2, 0.4, 0.7])
    x = np.zeros((4, 10))
    for i, r in enumerate(rows):
        for c, v in r.items():
            x[i, c] = v
    w, speed = np.zeros(10), np.zeros(10)
    for _ in range(40):
        at = w + 0.9 * speed
        slope = sum((1 / (1 + np.exp(-x[i] @ at)) - y[i]) * x[i] for i in range(4)) / 4 + 1e-4 * at
        speed = 0.9 * speed - 0.5 * slope
        w = w + speed
    got = quality.train(rows, y, rounds=40)
    assert np.allclose(got[:10], w) and not got[10:].any()


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classified(docs).join(labels, "doc_id").select("keep", "quality").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) / len(got) > 0.97
    good = [r.keep for r in got if r.quality == 1]
    assert sum(good) / len(good) > 0.98


def test_rows(odd, none, clashing):
    got = quality.classified(odd)
    assert got.count() == len(rows())
    keep = {r.doc_id: r.keep for r in got.collect()}
    assert keep[4] is False and keep[5] is False and keep[6] is False
    assert collected(quality.classified(clashing)) == collected(got)
    assert collected(quality.classified(odd)) == collected(got)
    assert quality.classified(none).count() == 0 and quality.kept(none).count() == 0
    assert quality.kept(clashing).columns == clashing.columns
    assert quality.kept(odd).count() == sum(r.keep for r in got.collect())
