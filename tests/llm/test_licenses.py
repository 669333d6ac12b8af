import random
import re

from nameweave.llm import licenses
from nameweave.llm.licenses import Template, license_blocks, license_labels
from tests.llm.conftest import collected


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, templates):
    """(label, start, score) of all blocks, each begun at each word."""
    w, out = words(text), set()
    for t in templates:
        own = words(t.text)
        for s in range(len(w)):
            block = w[s : s + len(own)]
            share = len({*own} & {*block}) / len({*own})
            if block[0] in own and share >= t.least - 1e-9 and (not t.phrase or block == own):
                out.add((t.label, s, round(share, 9)))
    return out


def row(doc_id, text, templates):
    found = brute(text, templates)
    phrases = {t.label for t in templates if t.phrase}
    base = [s for label, s, _ in found if label in phrases]
    listed = lambda x: ",".join(sorted(x))
    return (
        doc_id, len(words(text)), len(base), min(base, default=None), max(base, default=None),
        listed({x for x, _, _ in found} & phrases), listed({x for x, _, _ in found}), max((s for _, _, s in found), default=0.0), len(found),
    )


def texts():
    r = random.Random(11)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in words(t.text)})
    out = [None, "", "MIT license", "mit-license MIT  License!", "general public LICENSE", "license mit", "ſmit license", "naïve Apache\nLicense, é", "MIT"]
    for _ in range(150):
        some = [r.choice(vocabulary) if r.random() < 0.3 else f"w{r.randrange(50)}" for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):  # a template of which some words are lost, changed or moved
            own = [w for w in words(r.choice(licenses.TEMPLATES).text) if r.random() > 0.1]
            if r.random() < 0.4:
                r.shuffle(own)
            at = r.randrange(len(some) + 1)
            some[at:at] = own
        out.append(r.choice([" ", ", ", "\n"]).join(some))
    return out


def rounded(df):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


def test_all_blocks_by_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "under the mit license"), (None, None), (2, "MIT license"), (2, "MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rounded(license_labels(df)) == sorted(repr(row(i, t, licenses.TEMPLATES)) for i, t in rows)
    got = {(r.doc_id, r.label, r.start, round(r.score, 9)) for r in license_blocks(df.where("doc_id > 2")).collect()}
    assert got == {(i, *b) for i, t in rows if (i or 0) > 2 for b in brute(t, licenses.TEMPLATES)}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = license_labels(docs)
    assert rounded(got) == sorted(repr(row(r.doc_id, r.text, licenses.TEMPLATES)) for r in docs.collect())


def test_templates_of_repeated_words_and_other_shares(spark):
    some = [Template("twice", "the more the merrier", 1.0, True), Template("half", "a b c d e f", 0.5), Template("one", "x", 0.8)]
    rows = [(1, "the more the merrier the more the more the merrier"), (2, "a x b c"), (3, "f f f e e d"), (4, "the more merrier"), (5, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rounded(license_labels(df, some)) == sorted(repr(row(i, t, some)) for i, t in rows)


def test_odd_rows_ids_as_text_and_no_rows(spark, odd, clashing, none):
    assert collected(license_labels(clashing)) == collected(license_labels(odd))
    assert license_labels(none).collect() == [] and license_blocks(none).collect() == []
    named = spark.createDataFrame([("a", "mit license"), (None, "x"), ("", "y")], "doc_id string, text string")
    assert {(r.doc_id, r.n_base) for r in license_labels(named).collect()} == {("a", 1), (None, 0), ("", 0)}
