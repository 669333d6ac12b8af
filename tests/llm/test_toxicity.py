from pathlib import Path

import pytest

import corpus_pipeline
from nameweave.llm import toxicity
from tests.llm.conftest import PLAIN

SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stage_drops_english_toxic_documents_and_keeps_clean_ones(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    left = corpus_pipeline.classify(spark, docs, str(SF))
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    rows = docs.select("doc_id", "lang").join(labels, "doc_id").where("quality = 1").collect()
    toxic = [r.doc_id in ids for r in rows if r.toxic == 1 and r.lang == "en"]  # insults of the other, invented languages are in no lexicon
    clean = [r.doc_id in ids for r in rows if r.toxic == 0]
    assert sum(toxic) / len(toxic) < 0.05 and sum(clean) / len(clean) > 0.98


def test_learns_words_beyond_the_lexicons(spark):
    docs = [(i, f"{PLAIN} number{i}" + (" you stupid blorfing idiot" if i % 5 == 0 else "")) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    assert model.score_of(PLAIN) < 0.1 and model.score_of(docs[0][1]) > 0.9
    assert model.score_of(f"{PLAIN} blorfing") > 3 * model.score_of(PLAIN)
    assert model.score_of(None) == model.score_of(" ") == 0


def test_odd_rows(odd, none, clashing):
    left = toxicity.without_toxic(clashing)
    assert left.columns == clashing.columns and left.count() == odd.count()
    assert toxicity.without_toxic(none).count() == 0
