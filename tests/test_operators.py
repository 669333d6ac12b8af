import json
import random

import pytest
from pyspark.sql import functions as F

from nameweave.functions import text
from nameweave.operators import blocking, cluster, evaluate, filtering, jobs, numbering, prepare, requests, responses, vectors
from nameweave.operators.components import connected_components


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (0, "Ann Lee", '{"g": "ann", "s": "lee"}'),
        (1, "Anne Lee", '{"g": "anne", "s": "lee"}'),
        (2, "Bob", '{"g": "bob"}'),
        (3, "bad", '{"g": '),
        (4, "none", None),
        (5, "empty", "{}"),
        (6, "Lee Lee", '{"g": "lee", "s": "lee"}'),
    ]
    return spark.createDataFrame(rows, "rec_id long, title string, name_parts string").cache()


def pairs_of(df):
    return sorted((r[0], r[1]) for r in df.select("left_id", "right_id").collect())


def test_labels_and_empty_blocks(records):
    of = blocking.labelled(records, blocking.part_presence(F.col("name_parts")))
    found = pairs_of(blocking.pairs(of, of, same=True))
    assert (0, 1) in found and (0, 2) in found and (3, 4) not in found
    assert all(a != b for a, b in found)
    blocks = {r.left_id: r.block for r in blocking.as_blocks(blocking.pairs(of, of, same=True), blocking.left_keys(of)).collect()}
    assert blocks[3] == [] and blocks[5] == [] and set(blocks) == set(range(7))


def test_number_labels(spark):
    r = spark.createDataFrame([(i, n) for i, n in enumerate([3, 4, 5, 6, None])], "rec_id long, age int")
    of = blocking.labelled(r, blocking.age(F.col("age"), 1))
    assert pairs_of(blocking.pairs(of, of, same=True)) == [(a, b) for a in range(4) for b in range(4) if a != b and abs(a - b) <= 2]


def test_potential_length(spark):
    r = spark.createDataFrame([(0, '{"a": "xx", "b": "yyyy"}'), (1, "{}"), (2, "no")], "rec_id long, name_parts string")
    got = {x.rec_id: set(x.l) for x in r.select("rec_id", blocking.potential_length(F.col("name_parts"), 0).alias("l")).collect()}
    assert got == {0: {"2", "4", "6"}, 1: set(), 2: {"None"}}


def test_consonants(spark):
    r = spark.createDataFrame([("t͡ʃa*n",), (None,), ("aeo",)], "p string")
    assert [x[0] for x in r.select(blocking.consonants(F.col("p"))).collect()] == [["t͡ʃ", "n"], ["None"], ["None"]]


def every(records):
    of = blocking.labelled(records, blocking.everything())
    return blocking.pairs(of, of, same=True)


def test_filters(records):
    met = every(records)
    assert (0, 6) in pairs_of(filtering.by_any_part(met, records, records, 1.0))
    assert not [p for p in pairs_of(filtering.by_any_part(met, records, records)) if p[0] in (3, 4, 5) or p[1] in (3, 4, 5)]
    best = filtering.by_part_scores(met, records, records, 2).collect()
    assert {r.left_id for r in best} == {0, 1, 2, 5, 6} and max(r["rank"] for r in best) == 2
    assert all(sum(r.left_id == i for r in best) == 2 for i in (0, 1, 2, 5, 6))
    of_bob = sorted((r["rank"], r.right_id) for r in best if r.left_id == 5)
    assert of_bob == [(1, 0), (2, 1)]  # ties go to the smaller id
    score = {(r.left_id, r.right_id): r.score for r in filtering.by_assignment(met, records, records, 9).collect()}
    assert score[6, 2] == pytest.approx(0.0) and score[2, 0] <= 1 and score[0, 1] > 0.9
    assert score[6, 0] == pytest.approx(score[0, 6], abs=1)  # repeated words on the left count, on the right they don't
    hits = {(r.left_id, r.right_id): r.score for r in filtering.by_threshold(met, records, records).collect()}
    assert hits[0, 1] == 0.5 and hits[6, 0] == 1.0 and hits[0, 6] == 1.0 and (0, 3) not in hits and (3, 0) not in hits


def test_recall_counts_repeated_truth_rows(spark):
    found = spark.createDataFrame([(1, 2), (3, 4)], "left_id long, right_id long")
    truth = spark.createDataFrame([(1, 2), (1, 2), (5, 6)], "left_id long, right_id long")
    m = evaluate.metrics(found, truth).first()
    assert (m.n_found, m.precision, m.recall) == (1, 0.5, pytest.approx(1 / 3))
    none = evaluate.metrics(found.where("false"), truth.where("false")).first()
    assert (none.precision, none.recall, none.f1, none.f5) == (0, 0, 0, 0)
    assert pairs_of(evaluate.missed_matches(found, truth)) == [(5, 6)]


def test_f_beta(spark):
    f = lambda p, r, b: spark.range(1).select(evaluate.f_beta(F.lit(p), F.lit(r), b).alias("f")).first().f
    assert f(0.3956, 0.8145, 1) == pytest.approx(0.5326, abs=4e-4)
    assert f(0.3956, 0.8145, 5) == pytest.approx(0.7827, abs=4e-4)


def test_alignment_gives_null_for_a_missing_id(spark):
    records = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "rec_id long, k string")
    truth = spark.createDataFrame([("a", "b"), ("b", "x")], "p string, q string")
    assert sorted((r.p, r.left_id, r.right_id) for r in evaluate.first_alignment(truth, records, "k", "p", "q").collect()) == [("a", 0, 1), ("b", 1, None)]
    assert evaluate.unique_only(records, "k").count() == 1


def test_prepared(spark):
    a = spark.createDataFrame([("1", "A ", "1700-01-02", '{"g": "X"}'), ("2", "B", None, "{")], "id string, title string, birth_date string, name_parts string")
    b = spark.createDataFrame([("C", '{"s": "Y"}')], "title string, name_parts string")
    rows = prepare.prepared([a, b]).orderBy("data_source").collect()
    assert [(r.data_source, r.title, r.birth_date, r.g, r.s) for r in rows] == [(0, "a", "1700/01/02", "x", None), (1, "c", None, None, "y")]


def test_service_halves_large_requests_and_keeps_rows(spark):
    def send(df):
        if len(df) > 2:
            raise OverflowError
        return df.assign(phoneme=df["title"].str.upper())[["id", "phoneme"]]

    r = spark.createDataFrame([(str(i), f"t{i}") for i in range(7)] + [(None, "x")], "id string, title string").coalesce(1)
    got = prepare.through_service(r, send, ["title"], "id string, phoneme string").collect()
    assert {(x.id, x.phoneme, x.title) for x in got} == {(str(i), f"T{i}", f"t{i}") for i in range(7)}


def test_vectors(spark):
    base = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0, 0.0])], "id long, embedding array<float>")
    near = {(r.query_id, r["rank"]): (r.id, r.distance) for r in vectors.nearest_self(base, 2).collect()}
    assert near[1, 1] == (2, 1.0) and near[1, 2] == (4, 1.0) and near[2, 1] == (4, 0.0)
    for k in range(1, 5):
        assert vectors.nearest(base.select(F.col("id").alias("query_id"), "embedding"), base, k).count() == 4 * k
    up = vectors.upserted(spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "id long, v string, seq long"))
    assert sorted(map(tuple, up.collect())) == [(1, "c"), (2, "d")]
    e = spark.createDataFrame([("ann",), ("",), (None,)], "t string").select(vectors.hashed_embedding(F.col("t")).alias("e")).collect()
    assert sum(x * x for x in e[0].e) == pytest.approx(1, abs=1e-5) and not any(e[1].e) and not any(e[2].e)


def test_requests_and_responses(spark, records):
    met = spark.createDataFrame([(0, 1), (0, 2), (0, 6), (1, 0), (2, 3)], "left_id long, right_id long")
    cut = {r.right_id: (r.chunk, r.n) for r in requests.chunks(met, 2).where("left_id = 0").collect()}
    assert cut == {1: (0, 2), 2: (0, 2), 6: (1, 1)}
    keys = records.select(F.col("rec_id").alias("left_id"))
    assert {r.left_id: r.block for r in requests.leftovers(met, keys, 2).collect()} == {0: [6], 1: [0], 2: [3], 3: [], 4: [], 5: [], 6: []}
    line = json.loads(requests.choice_requests(met, records, records, 2).first().line)
    assert line["custom_id"] == "0-0" and line["body"]["messages"][2]["content"] == "Candidates: Anne Lee;Bob"
    asked = {r.custom_id for r in requests.pair_requests(met, records, records, text.parts_text(text.parts(F.col("name_parts")))).collect()}
    assert asked == {"0#1", "0#2", "0#6", "1#0"}
    said = spark.createDataFrame([("0#1", "True"), ("0#2", "It is True."), ("0#6", "False"), ("9#9", "True"), ("bad", "True"), ("1#0", None)], "custom_id string, content string")
    assert pairs_of(responses.positive_pairs(said)) == [(0, 1), (0, 2), (9, 9)]
    assert pairs_of(responses.pair_ids(responses.restricted(said, met).drop("left_id", "right_id"))) == [(0, 1), (0, 2), (0, 6), (1, 0)]
    scores = spark.createDataFrame([("0#1", "0.9"), ("0#2", " 0.9 "), ("0#6", "0.85"), ("1#0", "x"), ("2#3", "0.1")], "custom_id string, content string")
    assert pairs_of(responses.confident_pairs(scores)) == [(0, 1), (0, 2)]
    assert responses.unreadable_scores(scores).count() == 1
    lists = spark.createDataFrame([("0", "True\nno\nx True\nTrue\nTrue")], "custom_id string, content string")
    assert pairs_of(responses.conformed(met, responses.booleans(lists))) == [(0, 1), (0, 6)]
    assert [(r.left_id, r.block) for r in responses.densified(met.where("left_id = 1"), 3).orderBy("left_id").collect()] == [(0, []), (1, [0]), (2, [])]


def test_zero_shot_answers(spark):
    truth = spark.createDataFrame([(i, i < 6) for i in range(12)], "pos int, match boolean")
    answer = spark.createDataFrame([("\n".join("True  " if i < 3 else "False  " for i in range(12)),)], "content string")
    assert tuple(responses.answers_against_truth(answer, truth).first()) == (1.0, 0.5)


def test_split_files_conserves_lines(spark):
    rows = [(f"{i:03}", "é" * (i % 13 + 1)) for i in range(200)] + [("999", "x" * 99)]
    got = requests.split_files(spark.createDataFrame(rows, "custom_id string, line string"), size_limit=60, request_limit=4).collect()
    assert sorted((r.custom_id, r.line) for r in got) == sorted(rows)
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append(len(r.line.encode()) + 1)
    assert all(len(p) <= 4 and (sum(p) <= 60 or len(p) == 1) for p in parts.values())


def test_job_tracker():
    saved, stored = [], {}
    backend = jobs.OfflineBackend(str.upper, script={"batch-0": ["in_progress", "expired"]})
    t = jobs.Tracker([jobs.Job("a"), jobs.Job("b"), jobs.Job("c")], backend, budget=1, save=lambda j: saved.append(len(j)))
    t.prepare(lambda name: [name])
    t.prepare(lambda name: 1 / 0)  # nothing is uploaded twice
    t.run(stored.__setitem__)
    assert stored == {"a": ["A"], "b": ["B"], "c": ["C"]} and len(backend.jobs()) == 4 and saved
    failing = jobs.Tracker([jobs.Job("a"), jobs.Job("b")], jobs.OfflineBackend(str, script={"batch-0": ["failed"]}), budget=1)
    failing.prepare(lambda name: [name])
    failing.run(stored.__setitem__)
    assert failing.budget == 0 and not failing.jobs[1].started


def test_tracker_table(spark):
    table = jobs.tracker_table(spark, [jobs.Job("a", started=True)])
    assert table.first()["Started"] == "True"
    assert jobs.jobs_of(table) == [jobs.Job("a", started=True)]


def test_components(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (200, 300), (200, 300)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_rising_path_is_contracted_in_few_rounds(spark, monkeypatch):
    """By the smallest neighbour, a path of n nodes whose ids rise along it took n / 2 rounds."""
    from nameweave.operators import components

    rounds = []
    table = components.Table
    monkeypatch.setattr(components, "Table", lambda df, label, **k: (rounds.append(label), table(df, label, **k))[1])
    got = connected_components(spark.range(60).selectExpr("id AS a", "id + 1 AS b"), "a", "b").collect()
    assert len(got) == 61 and {r.component for r in got} == {0}
    assert rounds.count("edges") <= 12


def test_learned_clusters(spark):
    recs = [(0, "ann"), (1, "anna"), (2, "bob"), (3, "bobb"), (4, "zed")]
    r = spark.createDataFrame(recs, "rec_id long, title string")
    s = lambda n, k: r.select(F.col("rec_id").alias(k), F.struct("title").alias(n))
    met = s("a", "left_id").join(s("b", "right_id")).where("left_id < right_id")
    rows, names = cluster.pair_features(met, strings=["title"])
    labelled = rows.withColumn("label", (F.substring("a.title", 1, 1) == F.substring("b.title", 1, 1)).cast("int"))
    got = {x.rec_id: x.cluster_id for x in cluster.clusters(r, cluster.scored(cluster.train(labelled, names), labelled)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    out = cluster.cluster_output(r, cluster.clusters(r, spark.createDataFrame([(0, 1, 0.7)], "left_id long, right_id long, score double")))
    assert {(x.rec_id, x["Cluster ID"], x.confidence_score) for x in out.collect()} == {(0, 0, 0.7), (1, 0, 0.7), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)}


def test_comparators(spark):
    r = spark.createDataFrame([("a", "a"), ("a", "b"), ("", "b"), (None, "b")], "a string, b string")
    assert [tuple(x) for x in r.select(cluster.same_or_not(F.col("a"), F.col("b")), cluster.different_or_not(F.col("a"), F.col("b"), 1)).collect()] == [(0, 1), (1, 0), (None, None), (None, None)]


def test_row_numbers(spark):
    rows = [(i % 7, f"x{i % 3}", i) for i in range(300)] + [(None, None, 300 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, v string, i int").repartition(5)
    got = {r.i: r.row_number for r in numbering.numbered(df, ["k", "v", "i"], ranges=6).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2]))
    assert got == {r[2]: n for n, r in enumerate(order)}
    clash = numbering.numbered(df.withColumnRenamed("v", "range_").withColumnRenamed("k", "within_"), ["i"], "i2")
    assert clash.columns == ["within_", "range_", "i", "i2"] and all(r.i == r.i2 for r in clash.collect())
    read = numbering.numbered_as_read(spark.range(0, 100, 1, 7)).collect()
    assert all(r.id == r.rec_id for r in read)
    assert numbering.numbered(df.where("false"), ["i"]).count() == 0 == numbering.numbered_as_read(df.where("false")).count()


def test_files_are_filled_in_order(spark, monkeypatch):
    """Against filling one line after another."""
    monkeypatch.setattr(requests, "STRETCH", 8)
    lines = [(f"{i:04}", "x" * (i * 7919 % 50)) for i in range(500)] + [("9000", "y" * 500)]
    want, part, size, n = {}, 1, 0, 0
    for k, x in lines:
        if n and (n >= 9 or size + len(x) + 1 > 150):
            part, size, n = part + 1, 0, 0
        want[k], size, n = part, size + len(x) + 1, n + 1
    df = spark.createDataFrame(lines, "custom_id string, line string").repartition(3)
    assert {r.custom_id: r.part for r in requests.split_files(df, size_limit=150, request_limit=9).collect()} == want
    assert requests.split_files(df.where("false")).count() == 0


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = random.Random(3)
    points = [(i, [float(rng.randrange(4)) for _ in range(5)]) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(points, "id long, embedding array<float>")
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    want = set()
    for i, v in points[:90]:
        near = sorted((far(v, w), j) for j, w in points[:90] if i != j)[:6]
        want |= {(i, r, j, d) for r, (d, j) in enumerate(near, 1)}
    assert {(r.query_id, r["rank"], r.id, r.distance) for r in vectors.nearest_self(df, 6).collect()} == want
    assert vectors.nearest_self(df.where("false"), 3).count() == 0


def test_names_asked_of_a_collection(spark):
    rows = [("1", "Anna Levi", "a", 0), ("2", "Hanna Levy", "b", 1), ("3", "Boris Katz", "b", 2)]
    collection = spark.createDataFrame(rows, "id string, document string, source string, idx long").withColumn("embedding", vectors.hashed_embedding(F.col("document")))
    names = spark.createDataFrame([("1", "Anna Levi"), ("x", "Boris Kats")], "query_id string, title string")
    first = lambda **k: {r.query_id: r.id for r in vectors.nearest_by_name(collection, names, 1, **k).collect()}
    assert first() == {"1": "1", "x": "3"} and first(source="b") == {"1": "2", "x": "3"} and first(exclude_self=True)["1"] == "2"
    assert {(r.direction, r.query_id) for r in vectors.nearest_across_sources(collection, "a", "b", 1).collect()} == {("a to b", "1"), ("b to a", "2"), ("b to a", "3")}


def test_refused_jobs_wait_longer_each_time():
    waits = []
    backend = jobs.OfflineBackend(str.upper, script={"batch-0": ["validating", "failed"], "batch-1": ["failed"], "batch-2": ["in_progress"]})
    t = jobs.Tracker([jobs.Job("a"), jobs.Job("b")], backend)
    t.spawn(lambda name: [name], waits.append, 10)
    assert waits == [20, 10, 20] and all(j.started for j in t.jobs) and t.jobs[0].batch_id == "batch-2"


def test_single_question():
    asked = []
    said = requests.ask(lambda body: asked.append(body) or "True", "names", "First name: a Second name: b")
    assert said == "True" and asked[0]["messages"][0]["content"] == requests.INSTRUCTIONS["names"] and len(requests.INSTRUCTIONS) == 6


def test_active_learning(spark):
    """A model that asks for the pairs it doubts ends up better than the one it began with."""
    rng = random.Random(8)
    rows = [(i, i + 1000, rng.random(), float(rng.random())) for i in range(400)]
    pairs = spark.createDataFrame(rows, "left_id long, right_id long, f_0 double, f_1 double")
    true = pairs.select("left_id", "right_id", (F.col("f_0") > 0.5).cast("int").alias("label"))
    first = true.where("left_id < 12")
    rounds = []

    def ask(asked):
        rounds.append(asked.count())
        return asked.join(true, ["left_id", "right_id"])

    model, labelled = cluster.learnt_actively(pairs, ["f_0", "f_1"], first, ask, rounds=2, n=15)
    assert rounds == [15, 15] and labelled.count() == 12 + 30
    got = cluster.scored(model, pairs).join(true, ["left_id", "right_id"])
    assert got.where("(score > 0.5) = (label = 1)").count() > 350


def test_repaired_parts_are_read(spark):
    rows = [("1", '{""a"": ""x""}'), ("2", '{"a": "y"}'), ("3", "{"), ("4", '{""a"": """"}')]
    df = spark.createDataFrame(rows, "id string, name_parts string")
    assert {r.id: r.a for r in prepare.with_part_columns(prepare.accepted(df)).collect()} == {"1": "x", "2": "y", "4": ""}
    assert [r.id for r in prepare.rejected(df).collect()] == ["3"]


def test_metrics_of_repeated_rows(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "left_id long, right_id long")
    truth = spark.createDataFrame([(1, 2), (1, 2), (5, 6), (7, 8)], "left_id long, right_id long")
    r = evaluate.metrics(pairs, truth).first()
    assert (r.n_pairs, r.n_matches, r.n_found, r.recall) == (3, 4, 1, 0.25)
    none = evaluate.metrics(pairs.where("false"), truth.where("false")).first()
    assert (none.n_pairs, none.n_found, none.f1) == (0, 0, 0.0)


def test_equal_rows_are_numbered_in_even_ranges(spark):
    from nameweave.operators import numbering

    rows = spark.range(60_000).selectExpr("cast(null as long) as id", "'' as text").union(spark.range(10).selectExpr("id", "'x'"))
    got = numbering.numbered(rows, ["id", "text"], "n", ranges=30)
    assert sorted(r.n for r in got.select("n").collect()) == list(range(60_010))
    assert [r.id for r in got.where("n >= 60000").orderBy("n").collect()] == list(range(10))
    at = got.select("n").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    base = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(30, "id", "text", "at")
    sizes = base.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(sizes) < 6_000 and sum(at) == 60_010


@pytest.mark.parametrize(("size_limit", "request_limit", "stretch"), [(200, 50, 7), (90, 3, 64), (10_000, 1000, 16)])
def test_files_by_pointer_doubling_are_those_of_a_fold(spark, monkeypatch, size_limit, request_limit, stretch):
    monkeypatch.setattr(requests, "STRETCH", stretch)
    r = random.Random(size_limit)
    rows = [(f"{i:04d}", "x" * r.choice([0, 3, 10, 40, 150, 199])) for i in range(300)]
    want, size, n, part = {}, 0, 0, 1
    for key, line in rows:
        b = len(line) + 1
        if n and (n >= request_limit or size + b > size_limit):
            size, n, part = 0, 0, part + 1
        size, n = size + b, n + 1
        want[key] = part
    df = spark.createDataFrame(rows, "custom_id string, line string").repartition(5)
    assert {x.custom_id: x.part for x in requests.split_files(df, size_limit=size_limit, request_limit=request_limit).collect()} == want


def test_the_first_record_of_an_id_is_kept(spark):
    rows = [("1", "z first", "he"), ("1", "a later", "he"), ("2", "x", "he"), ("1", "b", "fr"), ("3", None, "he"), ("3", "y", "he")]
    df = spark.createDataFrame(rows, "id string, title string, lang string").coalesce(1)
    got = {r.id: r.title for r in prepare.of_language(df, "he").collect()}
    assert got == {"1": "z first@he", "2": "x@he", "3": None}
    assert {r.id: r.title for r in prepare.of_language(df, "he", ["title"]).collect()}["1"] == "a later@he"


def test_prepared_records_keep_a_natural_key(spark):
    """A table whose key isn't among the excluded columns keeps it, cleaned, for joins with the source."""
    a = spark.createDataFrame([("K-1", "9", " Ann ", '{"x": "Ann"}'), ("K-2", "8", "Bo", '{"x": "Bo"}')], "book_id string, id string, title string, name_parts string")
    got = prepare.prepared([a])
    assert "id" not in got.columns and {r.book_id: r.title for r in got.collect()} == {"k-1": "ann", "k-2": "bo"}
    assert "id" in prepare.prepared([a], excluded=("geo_id",)).columns


def _labels(spark, n, seed):
    import random

    r = random.Random(seed)
    rows = [(i, label) for i in range(n) for label in r.sample(["a", "b", "c", "d", "None"], r.choice([1, 1, 2]))]
    return spark.createDataFrame([*rows, *rows[:5], (None, "a"), (n, None)], "rec_id long, label string")


def test_blocks_are_counted_and_begun_without_pairs(spark):
    of = _labels(spark, 25, 3)
    made = blocking.pairs(of, of, same=True)
    plain = {r.left_id: r.n for r in evaluate.block_sizes(made, blocking.left_keys(of)).collect()}
    assert {r.left_id: r.n for r in blocking.sizes(of).collect()} == plain
    pairs = pairs_of(made)
    want = [(i, j) for i in range(25) for j in [b for a, b in pairs if a == i][:3]]
    assert pairs_of(blocking.first_pairs(of, 3)) == sorted(want)
    dense = responses.densified_sizes(blocking.sizes(of.where("rec_id is not null")), 30).collect()
    assert {r.left_id: r.n for r in dense} == {i: sum(a == i for a, _ in pairs) for i in range(30)}


def test_metrics_by_key_are_those_of_the_pairs(spark):
    of = _labels(spark, 25, 5)
    keys = spark.createDataFrame([(i, f"k{i % 4}" if i % 7 else None) for i in range(25)], "rec_id long, key string")
    by = blocking.labelled(keys, F.array("key"))
    made, matches = blocking.pairs(of, of, same=True), blocking.pairs(by, by, same=True)
    want = evaluate.metrics(made, matches).first()
    assert want.n_found > 0 and evaluate.metrics_by_key(made, keys).first() == want == evaluate.block_metrics(of, keys).first()
    swept = filtering.sweep(made.withColumn("rank", F.pmod("right_id", F.lit(5)).cast("int")), [1, 3])
    each = lambda m: sorted(tuple(r) for r in m.select("k", "n_pairs", "n_found", "n_matches", "f1").collect())
    assert each(evaluate.sweep_metrics_by_key(swept, keys)) == each(evaluate.sweep_metrics(swept, matches))
    of_clusters = keys.select("rec_id", F.pmod("rec_id", F.lit(3)).alias("cluster_id"))
    groups = keys.where("key is not null").withColumnRenamed("key", "g")
    truth = cluster.pairs_of_groups(groups, "g", "rec_id").toDF("left_id", "right_id")
    assert cluster.cluster_stats_by_key(of_clusters, keys).first().asDict() == cluster.cluster_stats(of_clusters, truth).first().asDict()
    rows = groups.select("rec_id", F.col("g").alias("found"), F.pmod("rec_id", F.lit(3)).cast("string").alias("true"))
    pairs = lambda c: cluster.pairs_of_groups(rows, c, "rec_id")
    assert cluster.group_set_stats(rows).first() == cluster.pair_set_stats(pairs("found"), pairs("true")).first()


def test_classes_have_the_best_candidates_of_their_records(spark):
    """Many records of the same names: a class is scored once, and its records' candidates are those of all pairs."""
    names = ["ann lee", "anna lee", "bob", "rob", "", None]
    json = [None if n is None else "{" + ", ".join(f'"p{i}": "{w}"' for i, w in enumerate(n.split())) + "}" for n in names]
    records = spark.createDataFrame([(i, json[i * i % 6 if i % 3 else i % 6]) for i in range(26)], "rec_id long, name_parts string")
    of = _labels(spark, 26, 8).where("rec_id is not null and rec_id < 26")
    made = blocking.pairs(of, of, same=True)
    order = F.round("score", 9)
    ways = [
        (lambda p, r, n: filtering.by_part_scores(p, r, r, n), None),
        (lambda p, r, n: filtering.by_threshold(p, r, r, n), None),
        (lambda p, r, n: filtering.by_assignment(p, r, r, n, order), order),
    ]
    rows = lambda df: sorted((r.left_id, r["rank"], r.right_id, round(r.score, 9)) for r in df.collect())
    for score, by in ways:
        want = rows(score(made, records, 3))
        assert want and rows(filtering.by_classes(of, records, 3, score, by)) == want


def test_lists_are_those_of_the_pairs(spark):
    of = _labels(spark, 25, 9).where("rec_id is not null and rec_id < 25")
    records = spark.createDataFrame([(i, f"t{i % 6}") for i in range(25)], "rec_id long, title string")
    made = blocking.pairs(of, of, same=True)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(requests.block_name_lists(of, records)) == rows(requests.name_lists(made, records)) != []
    assert rows(requests.block_list_requests(of, records)) == rows(requests.pair_list_requests(made, records, records))


def test_pairs_of_classes_are_those_of_their_records(spark):
    """Records of the same labels and value are asked about, scored and joined to their texts once; cells of 3 records cut the larger classes up."""
    of = _labels(spark, 25, 4).where("rec_id is not null and rec_id < 25")
    titles = [None if i == 7 else f"t{i % 3}" for i in range(25)]
    records = spark.createDataFrame(list(enumerate(titles)), "rec_id long, title string")
    found, members = blocking.classes(of, records.select("rec_id", F.col("title").alias("value")))
    met = blocking.class_pairs(found)
    made = blocking.pairs(of, of, same=True)
    assert found.agg(F.sum("n")).first()[0] == members.count() > found.count()
    got = blocking.of_records(met, members, [F.concat_ws("+", "l", "r").alias("x")], cell=3).collect()
    assert sorted((x.left_id, x.right_id) for x in got) == pairs_of(made) and met.agg(F.sum("n")).first()[0] == len(got)
    assert all(x.x == "+".join(titles[i] for i in (x.left_id, x.right_id) if titles[i]) for x in got)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(requests.block_pair_requests(of, records, F.col("title"))) == rows(requests.pair_requests(made, records, records, F.col("title"))) != []


def test_choices_are_those_of_the_pairs(spark):
    of = _labels(spark, 25, 9).where("rec_id is not null and rec_id < 25")
    records = spark.createDataFrame([(i, f"t{i % 6}") for i in range(25)], "rec_id long, title string")
    made = blocking.pairs(of, of, same=True)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for size in (2, 3, 10):
        assert rows(requests.block_choice_requests(of, records, size)) == rows(requests.choice_requests(made, records, records, size)) != []


def test_clusters_of_classes_are_those_of_the_pairs(spark):
    names = ["ann lee", "anna lee", "bob", "bobb", "zed"]
    records = spark.createDataFrame([(i, names[i * i % 5]) for i in range(24)], "rec_id long, title string")
    of = blocking.labelled(records, F.array(F.when(F.col("rec_id") < 20, F.pmod("rec_id", F.lit(3)).cast("string")).otherwise(F.concat(F.lit("x"), "rec_id"))))
    side = lambda name, key: records.select(F.col("rec_id").alias(key), F.struct("title").alias(name))
    pairs = blocking.pairs(of, of, same=True).where("left_id < right_id").join(side("a", "left_id"), "left_id").join(side("b", "right_id"), "right_id")
    label = (F.substring("a.title", 1, 1) == F.substring("b.title", 1, 1)).cast("int").alias("label")
    rows, features = cluster.pair_features(pairs, strings=["title"])
    rows = rows.select("*", label).cache()
    plain = cluster.train(rows, features)
    want = {r.rec_id: (r.cluster_id, r.confidence) for r in cluster.clusters(records, cluster.scored(plain, rows)).collect()}
    found, members = blocking.classes(of, records.select("rec_id", F.struct("title").alias("value")))
    met = blocking.class_pairs(found).where("left_id <= right_id").withColumn("n", F.when(F.col("left_id") == F.col("right_id"), F.col("n") / 2).otherwise(F.col("n")))
    few, features = cluster.pair_features(met.withColumnsRenamed({"l": "a", "r": "b"}), strings=["title"])
    few = few.select("*", label).cache()
    assert few.count() < rows.count() == few.agg(F.sum("n")).first()[0]
    weighted = cluster.train(few, features, weight="n")
    got = cluster.clusters_of_classes(records, found, members, cluster.scored(weighted, few)).collect()
    assert {r.rec_id: r.cluster_id for r in got} == {i: c for i, (c, _) in want.items()} and len(set(r.cluster_id for r in got)) > 3
    assert all(r.confidence == pytest.approx(want[r.rec_id][1], abs=1e-4) for r in got)


def test_a_block_object_is_written_and_read_by_lines(spark, tmp_path):
    """One object was a single text in a single task; now its entries are lines of many files, which together still are one object."""
    import gzip

    from nameweave.sources import readers, writers

    of = _labels(spark, 25, 9).where("rec_id is not null")
    lists = blocking.block_lists(of)
    rows = lambda df: sorted((r.left_id, list(r.block)) for r in df.collect())
    assert rows(lists) == rows(blocking.as_blocks(blocking.pairs(of, of, same=True), blocking.left_keys(of)))
    assert rows(blocking.block_lists(of, own=True)) == rows(blocking.as_blocks(blocking.pairs(of, of), blocking.left_keys(of)))
    path = tmp_path / "blocks"
    writers.block_object(lists, str(path))
    whole = "".join(gzip.open(f, "rt").read() for f in sorted(path.glob("part-*.gz")))
    assert sorted((int(k), v) for k, v in json.loads(whole).items()) == rows(readers.block_lists(spark, str(path))) == rows(lists)
    for name, text_ in (("indented", json.dumps(json.loads(whole), indent=1)), ("one_line", json.dumps(json.loads(whole)))):
        (tmp_path / name).write_text(text_)
        assert rows(readers.block_lists(spark, str(tmp_path / name))) == rows(lists)
    writers.block_object(lists.where("false"), str(path))
    assert readers.block_lists(spark, str(path)).count() == 0


def test_nearest_in_blocks_without_pairs(spark, tmp_path, monkeypatch):
    from nameweave.sources import writers

    monkeypatch.setattr(vectors, "BLOCK", 3)
    of = _labels(spark, 25, 9).where("rec_id is not null and rec_id < 25")
    rng = random.Random(5)
    e = spark.createDataFrame([(i, None if i == 4 else [float(rng.randrange(3)) for _ in range(3)]) for i in range(25)], "rec_id long, embedding array<float>")
    known = e.where("embedding is not null")
    rows = lambda df: sorted((r.left_id, r["rank"], r.right_id, r.distance) for r in df.collect())
    want = vectors.nearest_in_blocks(blocking.pairs(of, of, same=True), known, known, 4)
    assert rows(vectors.nearest_of_labels(of, e, 4)) == rows(want) != []
    blocks = lambda found: sorted((r[0], list(r[1])) for r in vectors.as_blocks(found.select(F.col("left_id").alias("query_id"), "rank", F.col("right_id").alias("id"))).collect())
    for own in (False, True):
        writers.block_object(blocking.block_lists(of, own), str(tmp_path / f"b{own}"))
        for exclude in (False, True):
            found = vectors.nearest_in_block_file(spark, str(tmp_path / f"b{own}"), e, e, 4, exclude)
            want = vectors.nearest_in_blocks(blocking.pairs(of, of, same=not own), known, known, 4, exclude)
            assert sorted((r.left_id, list(r.block)) for r in found.collect()) == blocks(want)


def _written(monkeypatch, module):
    """The tables that a module writes from now on, by their labels."""
    made = {}
    real = module.Table

    def table(df, label, *more, **named):
        made[label] = df
        return real(df, label, *more, **named)

    monkeypatch.setattr(module, "Table", table)
    return made


def test_records_of_large_classes_meet_in_small_pieces(spark, monkeypatch):
    """All rows that an input row is exploded into are held at once, so they are bounded."""
    of = blocking.labelled(spark.range(3000).select(F.col("id").alias("rec_id")), F.array(F.lit("x")))
    found, members = blocking.classes(of, of.select("rec_id", F.lit(0).alias("value")))
    made = _written(monkeypatch, blocking)
    assert blocking.of_records(blocking.class_pairs(found), members).count() == 3000 * 2999
    assert made["pieces_of_classes"].agg(F.max(F.size("ids"))).first()[0] <= 2 * blocking.SHARE


def test_vectors_of_blocks_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Spark takes a vector for one number, so it would broadcast a table that is many times as large as it thinks."""
    from nameweave.sources import writers

    of = _labels(spark, 25, 9).where("rec_id is not null and rec_id < 25")
    e = spark.range(25).select(F.col("id").alias("rec_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    writers.block_object(blocking.block_lists(of), str(tmp_path / "b"))
    made = _written(monkeypatch, vectors)
    assert vectors.nearest_in_block_file(spark, str(tmp_path / "b"), e, e, 4).count() > 0
    plan = made["rows_of_groups"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_many_pairs_of_classes_are_many_tasks(spark):
    """Kinds are few and small rows, so Spark would put all pairs of their classes into one task."""
    of = blocking.labelled(spark.range(300).select(F.col("id").alias("rec_id")), F.array(F.lit("x")))
    met = blocking.class_pairs(blocking.classes(of, of.select("rec_id", F.col("rec_id").alias("value")))[0])
    each = met.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in each) == 300 * 299 and len(each) > 1


def test_what_is_made_without_pairs_is_that_of_the_pairs(spark):
    of = _labels(spark, 25, 4).where("rec_id is not null and rec_id < 25")
    texts = [(i, f"t{i % 3}", None if i == 7 else "{" if i == 8 else json.dumps({"a": ("ann", "anne", "bob", "lee")[i % 4], "b": f"x{i % 2}"})) for i in range(25)]
    records = spark.createDataFrame(texts, "rec_id long, title string, name_parts string")
    keys = records.select("rec_id", F.when(F.col("rec_id") != 3, F.concat("title", F.lit("|"))).alias("key"))
    made = blocking.pairs(of, of, same=True)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert pairs_of(filtering.block_by_any_part(of, records)) == pairs_of(filtering.by_any_part(made, records, records)) != []
    of_keys = blocking.labelled(keys.where("key is not null"), F.array("key"))
    want = evaluate.missed_report(made, blocking.pairs(of_keys, of_keys, same=True), records, records)
    assert rows(evaluate.block_missed_report(of, keys, records)) == rows(want) != []
    for size in (2, 3):
        assert rows(requests.block_chunks(of, size)) == rows(requests.chunks(made, size)) != []
        assert rows(requests.block_leftovers(of, size)) == rows(requests.leftovers(made, blocking.left_keys(of), size)) != []


def test_equal_rows_in_runs(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 1)], "k long, x string, n long")
    assert sorted(r.x for r in blocking.as_often(rows, "n", ["k"], 4).collect()) == ["a"] * 10 + ["b"]


@pytest.mark.parametrize("limits", [(10**9, 4), (900, 50)])
def test_list_files_are_those_of_their_lines(spark, monkeypatch, limits):
    """Lines aren't written or shuffled before they go to their file: no table on the way has them."""
    of = _labels(spark, 25, 9).where("rec_id is not null and rec_id < 25")
    records = spark.createDataFrame([(i, None if i == 5 else f't"{i % 6}') for i in range(25)], "rec_id long, title string")
    lines = requests.block_list_requests(of, records)
    want = requests.split_files(lines.withColumn("k", F.lpad("custom_id", 9, "0")), "k", *limits)
    made = _written(monkeypatch, requests)
    got = requests.block_list_files(of, records, *limits)
    rows = lambda df: sorted(map(tuple, df.select("custom_id", "line", "part").collect()))
    assert rows(got) == rows(want) != [] and not any("line" in df.columns and dict(df.dtypes)["line"] == "string" for df in made.values())
