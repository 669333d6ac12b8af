import random
from pathlib import Path

import pytest

import corpus_pipeline
from nameweave.llm import near_copies, simhash
from tests.llm.conftest import rows

SF = Path("/root/testdata/sf0.01")


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    """Smallest doc_id reachable, from all pairs of documents: equal texts, or Jaccard similarity of at least 0.8."""
    s = [sets(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            near = (docs[i][1] or "") == (docs[j][1] or "") or (s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]))
            if near and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((d for (d, _), x in zip(docs, group, strict=True) if x == g and d is not None), default=None) for g in set(group)}
    return sorted((repr((d, least[g])) for (d, _), g in zip(docs, group, strict=True)))


def found(df):
    return sorted(repr((r.doc_id, r.component_id)) for r in near_copies.near_copies(df).collect())


def test_near_copies_against_brute_force(spark):
    rng = random.Random(12)
    docs = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(rng.randrange(60, 200))]
        for _ in range(12):
            w = list(words)
            for _ in range(rng.randrange(9)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(w)))
    rng.shuffle(docs)
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute_components(docs)


def test_odd_rows(odd, none):
    assert found(odd) == brute_components([(i, t) for i, t, *_ in rows()])
    assert near_copies.without_near_copies(none).count() == 0
    left = near_copies.without_near_copies(odd)
    assert left.columns == odd.columns and not {2, 3} & {r.doc_id for r in left.select("doc_id").collect()}


def test_pipeline_keeps_no_near_copies(odd, spark):
    docs = odd.where("doc_id in (1, 2, 3, 10)")
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == {1, 3, 10}  # SimHash's two bits see no copy in 3
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()) == [1, 10]


def test_rows_without_id_are_apart(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(None, text), (None, text + " more"), (None, "other words"), (4, "x y z"), (4, "p q r s"), (None, "other words")]
    left = sorted(map(repr, map(tuple, near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect())))
    assert left in (sorted(map(repr, [docs[k], *docs[2:5]])) for k in (0, 1))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_recall_on_the_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert found(df) == brute_components([tuple(r) for r in df.collect()])
