import hashlib
import random
import re

from pyspark.sql import functions as F

from nameweave.llm import decontaminate
from tests.llm.conftest import collected, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in windows[k] if x is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_query(spark, odd, none, clashing, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    docs = [(i, t) for i, t, *_ in rows()]
    found = decontaminate.contamination(odd, benchmark)
    assert got(found) == brute(docs, items)
    assert collected(decontaminate.contamination(clashing, benchmark.withColumn("words", F.lit(1)))) == collected(found)
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert got(decontaminate.contamination(odd, benchmark.where("false"))) == brute(docs, [])


def test_random_texts(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 6, 12]))) for i in range(12)] + [(None, "a b c a b c c c")]
    docs = [(i, text(rng.randrange(40))) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(d, b, 5)) == brute(docs, items, 5)


def test_shingles_beyond_a_broadcast(spark, odd, benchmark):
    d = spark.createDataFrame([(i, t) for i, t, *_ in rows()], "doc_id long, text string")
    for size in (10, 5):
        few, many = (sorted(map(repr, decontaminate.hits(d, benchmark, size, most).collect())) for most in (None, 0))
        assert few == many and few


def test_rows_without_id_are_apart(spark, benchmark):
    docs = [(None, "another line"), (None, "clean words here"), (5, "another line of it"), (5, "clean too")]
    left = decontaminate.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [docs[1], docs[3]]))


def test_stage(odd, none, benchmark):
    left = decontaminate.decontaminated(odd, benchmark)
    assert left.columns == odd.columns
    ids = {r.doc_id for r in left.collect()}
    assert not ids & {1, 2, 3, 7, 10, 11} and {4, 5, 6, 8, 9} <= ids
    assert decontaminate.decontaminated(none, benchmark).count() == 0
