import json

from nameweave.operators import responses
from nameweave.sources import readers, writers
from nameweave.streaming import responses as streams


def test_csv_with_json_round_trip(spark, tmp_path):
    rows = [("a", '{"k": "x, \\"y\\""}'), ("b\nc", '"'), (None, "é")]
    df = spark.createDataFrame(rows, "id string, name_parts string")
    writers.delimited(df, str(tmp_path / "t"), "\t")
    assert sorted(map(str, readers.delimited(spark, str(tmp_path / "t"), "\t").collect())) == sorted(map(str, df.collect()))


def test_blocks_keep_empty_lefts(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"1": [2, 3, 3], "4": []}, indent=1))
    pairs, keys = readers.blocks(spark, str(tmp_path / "b.json"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3)] and sorted(r.left_id for r in keys.collect()) == [1, 4]


def test_embeddings(spark, tmp_path):
    (tmp_path / "e.csv").write_text('id,title,embedding\n1,a,"[0.5, 1]"\n')
    assert readers.embeddings(spark, str(tmp_path / "e.csv")).first().embedding == [0.5, 1.0]


def test_other_sinks(spark, tmp_path):
    t = str(tmp_path)
    df = spark.createDataFrame([("ab", '{"x": 1}')], "text string, j string")
    writers.characters(df, t + "/c")
    assert sorted(r.value for r in spark.read.text(t + "/c").collect()) == ["a", "b"]
    writers.unquoted(df, t + "/u")
    assert readers.unquoted(spark, t + "/u").first().j == '{"x": 1}'
    for _ in range(2):
        writers.log(df.selectExpr("text AS value"), t + "/l")
    assert spark.read.text(t + "/l").count() == 2
    writers.collection(df, t, "c1")
    assert readers.collection(spark, t, "c1").count() == 1


def _line(custom_id, content):
    return json.dumps({"custom_id": custom_id, "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_response_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(_line("1#2", "True") + "\n" + _line("1#3", "False") + "\n")
    truth = spark.createDataFrame([(1, 2), (5, 6)], "left_id long, right_id long")
    seen = []

    def go():
        stream = streams.response_stream(spark, str(folder))
        streams.running_metrics(stream, truth, str(tmp_path / "p"), str(tmp_path / "c"), lambda n, m: seen.append((n, m["n_found"]))).awaitTermination(60)

    go()
    (folder / "b.jsonl").write_text(_line("5#6", "True") + "\n")
    go()
    assert seen == [(0, 1), (1, 2)]


def test_running_metrics_are_those_of_a_batch_run(spark, tmp_path):
    """After each start, and after a batch that is run again, as after a loss before its commit."""
    import random
    import shutil

    from nameweave.operators import evaluate

    r = random.Random(3)
    folder = tmp_path / "in"
    folder.mkdir()
    truth = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(0, 1)], "left_id long, right_id long")
    seen = {}

    def go():
        streams.running_metrics(streams.response_stream(spark, str(folder)), truth, str(tmp_path / "p"), str(tmp_path / "c"), seen.__setitem__).awaitTermination(120)

    for turn in range(3):
        lines = [_line(f"{r.randrange(12)}#{r.randrange(13)}", r.choice(["True", "True, I think", "False"])) for _ in range(40)]
        (folder / f"{turn}.jsonl").write_text("\n".join(lines) + "\n")
        go()
        want = evaluate.metrics(responses.positive_pairs(responses.parsed(readers.lines(spark, str(folder)))), truth).first().asDict()
        assert seen[turn] == want
    before = dict(seen)
    for name in ("2", ".2.crc"):
        (tmp_path / "c" / "commits" / name).unlink()
    shutil.rmtree(tmp_path / "p" / "batch=2")
    go()
    assert seen == before and spark.read.parquet(str(tmp_path / "p")).count() == before[2]["n_pairs"]


def test_responses_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text((_line("1#2", "True") + "\n") * 3)
    q = streams.deduplicated(streams.response_stream(spark, str(folder))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 1
    assert responses.parsed(readers.lines(spark, str(folder))).count() == 3
