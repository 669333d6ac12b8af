import zlib

import numpy as np

from nameweave.llm import grammar
from tests.llm.conftest import PLAIN
from tests.llm.test_near_copies import brute_components as near_components
from tests.llm.test_simhash import brute_components


def test_stages(spark, tmp_path):
    import corpus_pipeline

    words = PLAIN.split()
    docs = [(i, " ".join([*words[i % 7 :], f"and so the name of the place is n{i} to us", *words[: i % 7]]), "en", f"s{i % 3}") for i in range(30)]
    docs += [(100, docs[0][1], "en", "s0"), (101, docs[1][1], "en", "s1"), (102, "### %%% $$$ *** ### %%% $$$ *** @@@", "en", "s0"), (103, None, None, None), (104, "the leaked words of an item are here in the text of this page as it was", "en", "s2")]
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "leaked words of an item are here in the text of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    after = {}
    rows = df
    for name, stage in corpus_pipeline.STAGES:
        after[name] = rows = stage(spark, rows, str(tmp_path)).cache()
        if name != "token_output":
            assert rows.columns == df.columns
    ids = {n: {r.doc_id for r in after[n].select("doc_id").collect()} for n in after}
    assert ids["quality_classifier"] >= set(range(30)) | {100, 101, 104} and not ids["quality_classifier"] & {102, 103}
    before = [(r.doc_id, r.text) for r in after["quality_classifier"].collect()]
    least = {c for _, _, c in brute_components(before)}
    near = near_components([(i, t) for i, t in before if i in least])  # by five-word similarity, after SimHash
    assert ids["simhash_near_dedup"] == {i for i in least if repr((i, i)) in near}
    assert ids["benchmark_decontamination"] == ids["simhash_near_dedup"] - {104}
    assert ids["mixing"] <= ids["benchmark_decontamination"]

    enc, start, want = grammar.Encoder(grammar.default_tokenizer()), 0, []
    for r in sorted(after["mixing"].collect(), key=lambda r: (r.doc_id, r.text)):
        x = np.array([*enc.tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, after["token_output"].collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_odd_rows_through_all_stages(spark, odd, none, clashing, benchmark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names, and an empty table."""
    import corpus_pipeline

    more = clashing.selectExpr("*", "1 as text_key", "2 as __drop_id", "3 as component_id", "4 as stays", "5 as __copies")
    benchmark.write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    more.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd").cache()
        assert docs.columns == more.columns, name
        if name == "simhash_near_dedup":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts))  # one of each group, those without an id included
            assert "a text without id" in texts or not odd.where("text = 'a text without id'").count()
    assert corpus_pipeline.tokenize(spark, docs, f"{tmp_path}/odd").count() == docs.count()
    benchmark.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_rows_without_id_stand_for_themselves(spark, benchmark, tmp_path):
    """A copy or a contaminated row without id takes no other one along."""
    import corpus_pipeline

    plain = [" ".join([*PLAIN.split()[i:], f"and so the name of the place is n{i} to us and no one has been there for it was so far", *PLAIN.split()[:i]]) for i in range(8, 13)]  # no item's window is whole in these
    docs = [(None, plain[0]), (None, plain[0]), (None, plain[1]), (None, "another line " + plain[2]), (5, plain[3]), (5, plain[4])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    deduplicated = corpus_pipeline.deduplicate(spark, df, str(tmp_path)).cache()
    assert sorted(r.text for r in deduplicated.collect()) == sorted([plain[0], plain[1], docs[3][1], plain[3], plain[4]])
    clean = corpus_pipeline.decontaminated(spark, deduplicated, str(tmp_path))
    assert not {docs[3][1]} & {r.text for r in clean.collect()} and plain[1] in {r.text for r in clean.collect()}


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)
