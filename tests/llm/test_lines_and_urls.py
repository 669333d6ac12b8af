import datetime
import random

import pytest
import xxhash

from nameweave import scratch
from nameweave.llm import columns, line_dedup, url_filter
from tests.llm.conftest import collected, rows


def key(t):
    return xxhash.xxh64_intdigest((t or "").encode(), 42) ^ (1 << 63)  # in the order of the signed hash


def brute(docs):
    """Kept line numbers of each row, from all pairs of lines; rows equal in doc_id and text are one document."""
    sets = {}
    for d, t in docs:
        for i, line in enumerate(t.split("\n") if t is not None else []):
            if w := frozenset(x for x in line.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x):
                sets[(d is not None, d or 0), key(t), i] = w
    order = sorted(sets)
    kept = {at for k, at in enumerate(order) if not any(len(sets[at] & sets[b]) >= 0.8 * len(sets[at] | sets[b]) - 1e-9 for b in order[:k])}
    out = []
    for d, t in docs:
        lines = t.split("\n") if t is not None else []
        keep = [i for i, line in enumerate(lines) if not line.strip(" \t\x0b\x0c\r") or ((d is not None, d or 0), key(t), i) in kept]
        out.append((d, len(lines), len(lines) - len(keep), ",".join(map(str, keep))))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_odd_rows(odd, none, clashing):
    found = line_dedup.line_decisions(odd)
    assert got(found) == brute([(i, t) for i, t, *_ in rows()])
    assert got(line_dedup.line_decisions(clashing)) == got(found)
    assert line_dedup.line_decisions(none).count() == 0
    out = line_dedup.deduplicated(clashing)
    assert out.columns == clashing.columns and out.count() == len(rows())
    assert {r.doc_id: r.text for r in out.collect()}[10] == "one line here that is shared\n\nanother line of words for all of us to read today\n"


def test_words_are_counted_side_by_side(spark):
    """Counts are exact by bucket, and come from a SIDE-th as many groups as there are buckets."""
    df = spark.createDataFrame([(1, "a b  a\nc\ta"), (2, None), (3, "b"), (4, "")], "doc_id long, text string")
    found = line_dedup.counts(df)
    want = [0] * line_dedup.BUCKETS
    for w in "abacab":
        want[xxhash.xxh64_intdigest(w.encode(), 42) % line_dedup.BUCKETS] += 1 << 40
    assert list(found.first()["counts"]) == want
    assert f"Range (0, {line_dedup.BUCKETS // 8}," in found._jdf.queryExecution().optimizedPlan().toString()


def test_many_lines(spark):
    """Documents of more lines than one number has bits for, some of runs of lines that all go, with blank lines of all kinds."""
    rng = random.Random(5)
    line = lambda: rng.choice(["", "  ", "\t", "the same few words again", f"w{rng.randrange(9)}", f"x{rng.random()} y{rng.random()}"])
    docs = [(i, "\n".join(line() for _ in range(n))) for i, n in enumerate((15, 16, 17, 33, 70, 1, 2))]
    docs += [(20, "\n".join(["the same few words again"] * 40 + ["an end"])), (21, "\n"), (22, " \n x"), (23, "y \n \t")]
    assert got(line_dedup.line_decisions(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines(spark, seed):
    rng = random.Random(seed)
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(30)}" for _ in range(rng.choice([1, 3, 5, 9, 14, 70, 90]))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        rng.shuffle(w)
        return " ".join(w)

    docs = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(70)]
    assert got(line_dedup.line_decisions(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_shared_and_other_ids(spark, monkeypatch):
    """Rows of one doc_id or none are apart by their texts; ids may be strings; long lists aren't broadcast."""
    docs = [(None, "a b c d e\nf g h i j"), (None, "f g h i j\na b c d e"), (None, "k"), (3, "a b c d e\nnew"), (3, "q\na b c d e"), (3, "q\na b c d e"), (2, ""), (1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert got(line_dedup.line_decisions(df)) == want
    named = line_dedup.line_decisions(df.withColumn("doc_id", df.doc_id.cast("string")))
    assert sorted(repr((None if r[0] is None else int(r[0]), *r[1:])) for r in named.collect()) == want
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(columns, "BROADCAST_BYTES", 0)
    assert got(line_dedup.line_decisions(df)) == want


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def brute_verdicts(captures, events):
    held = []
    for entry in {(e[0], e[1]) for e in events if None not in (e[0], e[1], e[4])}:
        by_day = {}
        for e in events:
            if (e[0], e[1]) == entry and e[4] is not None:
                by_day[e[4]] = max(by_day.get(e[4], (False, "")), (e[3], e[2]))
        days = sorted(by_day)
        held += [(*entry, by_day[a][1], a, b) for a, b in zip(days, [*days[1:], None], strict=True) if by_day[a][0]]
    out = []
    for page, url, at in captures:
        rest = (url or "").lower().partition("://")[2].split("?")[0].split("#")[0]
        host, _, path = rest.partition("/")
        path = [p for p in path.split("/") if p]
        labels = host.split(".")
        keys = ({".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {"/".join([host, *path[:i]]) for i in range(1, len(path) + 1)}) if host else set()
        live = [h for h in held if h[1] in keys and at is not None and h[3] <= at and (h[4] is None or at < h[4])]
        best = max(live, key=lambda h: (len(h[1]), h[3], h[0]), default=None)
        out.append((page, host, at, len(live), best and best[1], best and best[2], best and best[3], bool(best and best[2] == "block")))
    return sorted(map(repr, out))


def test_verdicts(spark):
    rng = random.Random(14)
    keys = ["a.com", "x.a.com", "x.a.com/p", "x.a.com/p/q", "b.org", "com"]
    events = [(f"e{rng.randrange(9)}", rng.choice(keys), rng.choice(["block", "allow"]), rng.random() < 0.6, day(rng.randrange(200))) for _ in range(60)] + [(None, "a.com", "block", True, day(1)), ("e1", None, "block", True, day(1)), ("e1", "a.com", "block", True, None)]
    urls = ["http://x.a.com/p/q/r?z=1", "https://A.com/", "http://b.org#top", "http://x.a.com/P", "mailto:x", "", None, "http://c.net/a"]
    captures = [(i % 70, rng.choice(urls), rng.choice([day(rng.randrange(250)), day(3), None])) for i in range(90)] + [(1, "http://b.org", day(5))] * 3 + [(None, "http://b.org", day(5))]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    e = spark.createDataFrame(events, "entry_id string, key string, action string, listed boolean, dated date")
    assert got(url_filter.verdicts(c, e)) == brute_verdicts(captures, events)
    assert url_filter.verdicts(c.where("false"), e).count() == 0
    assert got(url_filter.verdicts(c, e.where("false"))) == brute_verdicts(captures, [])


def test_forms_of_hosts_and_keys(spark):
    urls = ["http://example.com./a", "https://[2001:db8::1]:80/x", "http://192.168.1.1/", "http://u:p@Sub.Example.COM:8080//a//b", "http://h.org/" + "p/" * 5000, "http://[::1", "http://..."]
    events = [("e1", "Example.COM", "block", True, day(0)), ("e2", "168.1.1", "block", True, day(0)), ("e3", "[2001:db8::1]", "allow", True, day(0)), ("e4", "sub.example.com./A/", "allow", True, day(0)), ("e5", "", "block", True, day(0)), ("e6", "h.org/" + "p/" * 4000, "block", True, day(0))]
    c = spark.createDataFrame([(i, u, day(1)) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    e = spark.createDataFrame(events, "entry_id string, key string, action string, listed boolean, dated date")
    found = {r.page_id: (r.host, r.n_active, r.blocked) for r in url_filter.verdicts(c.selectExpr("*", "1 as key", "2 as n", "3 as periods"), e).collect()}
    assert found == {0: ("example.com", 1, True), 1: ("[2001:db8::1]", 1, False), 2: ("192.168.1.1", 0, False), 3: ("sub.example.com", 2, False), 4: ("h.org", 1, True), 5: ("", 0, False), 6: ("", 0, False)}


def test_odd_dates_cost_no_rows(spark):
    dates = [datetime.date(1, 1, 1), day(3), datetime.date(9999, 12, 31)]
    c = spark.createDataFrame([(i, "http://a.com", d) for i, d in enumerate(dates)], "page_id long, url string, fetched date")
    e = spark.createDataFrame([(f"e{i}", "a.com", "block", True, d) for i, d in enumerate([datetime.date(1, 1, 1), day(0)])], "entry_id string, key string, action string, listed boolean, dated date")
    assert {r.page_id: r.n_active for r in url_filter.verdicts(c, e).collect()} == {0: 1, 1: 2, 2: 2}


def test_made_list(spark, none):
    pages = spark.createDataFrame([(1, "http://h.example.com/en/1"), (None, None), (2, "")], "page_id long, url string")
    found = url_filter.verdicts(url_filter.fetched_pages(pages), url_filter.dated_list(pages))
    assert found.count() == 3 and collected(found)


def test_backslashes_blanks_and_very_long_urls(spark):
    import time

    urls = [r"http://ex.com\@evil.com/a", r"https:\\Ex.com\a\\b?x", "  http://ex.com/a/b", "http://ex.com/" + "a/" * 40_000, "http://" + "a." * 20_000 + "com/"]
    c = spark.createDataFrame([(i, u, day(1)) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    rows = [("e", "ex.com", "block", True, day(0)), ("f", "ex.com/a/b", "allow", True, day(0)), ("g", "ex.com/a/a/a", "block", True, day(0)), ("h", "a.com", "block", True, day(0))]
    e = spark.createDataFrame(rows, "entry_id string, key string, action string, listed boolean, dated date")
    url_filter.verdicts(c.limit(1), e).collect()
    began = time.time()
    found = {r.page_id: (r.host[:9], r.n_active, r.entry_key) for r in url_filter.verdicts(c, e).collect()}
    assert time.time() - began < 15
    assert found == {0: ("ex.com", 1, "ex.com"), 1: ("ex.com", 2, "ex.com/a/b"), 2: ("ex.com", 2, "ex.com/a/b"), 3: ("ex.com", 2, "ex.com/a/a/a"), 4: ("a.a.a.a.a", 1, "a.com")}
