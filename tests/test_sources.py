"""Splittable JSON, stores that ask once, sets of tables, retried requests."""

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import provider
from tallyloom.sources import fetch, files, json_array, publish, store

NASTY = ['say "hi", {you}', "back\\slash", 'quote \\" brace }', "[1, {2}]", "é \n}", "", "}]},{[", "\\\\", '"']


def records(n, seed=1):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(NASTY) for _ in range(draw.randint(0, 6)))
    return [{"id": i, "t": text(), "f": {"g": [draw.randint(0, 5) for _ in range(draw.randint(0, 4))], "h": text(), "none": None, "e": {}}, "x": i / 4 if i % 3 else None} for i in range(n)]


SCHEMA = "id long, t string, f struct<g:array<long>,h:string>, x double"


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
@pytest.mark.parametrize("style", ["array", "indented", "lines", "one"])
def test_json_in_ranges_equals_the_plain_reader(spark, tmp_path, split, style):
    rows = records(120 if style != "one" else 1)
    body = {
        "array": lambda r: json.dumps(r, ensure_ascii=False),
        "indented": lambda r: json.dumps(r, indent=3),
        "lines": lambda r: "\n".join(json.dumps(x) for x in r) + "\n",
        "one": lambda r: json.dumps(r[0], indent=1),
    }[style]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(body(rows[:70]) + "\n", encoding="utf-8")
    if style != "one":
        (tmp_path / "in" / "b.json").write_text(body(rows[70:]), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = f"file://{tmp_path}/in"
        got = json_array.read_records(spark, path, SCHEMA)
        assert split > 1000 or style == "one" or got.rdd.getNumPartitions() > 4
        want = spark.read.schema(SCHEMA).json(path, multiLine=style != "lines")
        key = lambda df: sorted(map(str, df.collect()))
        assert key(got) == key(want)
        assert sorted(json.loads(r.value)["id"] for r in json_array.read_texts(spark, path).collect()) == list(range(len(rows)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_without_a_schema_and_without_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(records(30)))
    got = files.read_dataset(spark, f"file://{tmp_path}/a.json")
    assert {"id", "t", "f", "x"} <= set(got.columns) and got.count() == 30
    assert dict(got.dtypes)["id"] == "bigint" and dict(got.dtypes)["x"] == "double"
    for i, text in enumerate(("[]", "", " [ ] \n", '[{"a": 1}, {"a": ')):
        (tmp_path / f"e{i}.json").write_text(text)
        assert files.read_dataset(spark, f"file://{tmp_path}/e{i}.json", "a long").count() == (2 if i == 3 else 0)


def test_written_arrays_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, NASTY[i % len(NASTY)], None if i % 3 else i / 2) for i in range(50)], "a long, b string, c double")
    json_array.write_array(df, f"file://{tmp_path}/out", files=3)
    back = json_array.read_records(spark, f"file://{tmp_path}/out", "a long, b string, c double")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_a_set_is_published_whole_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    one = spark.createDataFrame([(1,)], "x long")
    assert publish.published(spark, folder) == {}
    publish.publish({"a": one, "b": one}, folder)
    first = publish.published(spark, folder)
    broken = one.select(F.raise_error(F.lit("broken")).cast("long").alias("x"))
    with pytest.raises(Exception, match="broken"):
        publish.publish({"a": one.union(one), "b": broken}, folder)
    assert publish.published(spark, folder) == first and files.read_published(spark, folder, "a").count() == 1
    publish.publish({"a": one.union(one)}, folder)
    assert files.read_published(spark, folder, "a").count() == 2 and publish.published(spark, folder)["b"] == first["b"]
    publish.publish({"a": one}, folder)
    publish.drop_old(spark, folder, keep=1)
    assert files.read_published(spark, folder, "a").count() == 1 and files.read_published(spark, folder, "b").count() == 1
    assert len([p for p in (tmp_path / "runs").iterdir() if p.name.startswith("set-")]) == 2


def test_results_are_published_together(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, block_count long")
    files.write_results(df, spark.createDataFrame([(0.5,)], "kappa double"), f"file://{tmp_path}/r")
    assert [r.id for r in files.read_published(spark, f"file://{tmp_path}/r", "records").collect()] == [1]
    assert files.read_published(spark, f"file://{tmp_path}/r", "summary").first().kappa == 0.5


@pytest.fixture
def service():
    """Answers a prompt with its length, the first time that it hears of one marked flaky with an error, and one marked bad always."""
    heard, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            with lock:
                heard.append(prompt)
                fails = "bad" in prompt or ("flaky" in prompt and heard.count(prompt) == 1)
            body = b"{}" if fails else json.dumps({"response": f"{len(prompt)}"}).encode()
            self.send_response(500 if fails else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", heard
    server.shutdown()


def test_flaky_requests_are_retried_and_bad_ones_fail_alone(spark, service):
    url, heard = service
    df = spark.createDataFrame([("plain",), ("flaky one",), ("bad",), (None,)], "prompt string")
    got = {r.prompt: (r.response, r.error) for r in provider.answer(df, provider.http_provider(url, "m"), partitions=2, window=3, retries=1, back_off=0.01).collect()}
    assert got["plain"] == ("5", None) and got["flaky one"] == ("9", None) and got[None] == ("0", None)
    assert got["bad"][0] is None and "500" in got["bad"][1] and heard.count("bad") == 2 and heard.count("plain") == 1


def test_stored_answers_are_asked_for_once(spark, service, tmp_path):
    url, heard = service
    path, make = f"file://{tmp_path}/store", provider.http_provider(url, "m")
    df = spark.createDataFrame([(1, "same", 0), (2, "same", 0), (3, "same", 1), (4, "bad", 0), (5, "flaky", 0), (6, None, 0)], "k long, prompt string, pass int")
    for _ in range(2):
        got = {r.k: r.response for r in provider.answer_stored(df, make, path, by=("pass",), wave_rows=2, retries=0, back_off=0.0).collect()}
    assert got == {1: "4", 2: "4", 3: "4", 4: None, 5: "5", 6: "0"}
    assert heard.count("same") == 2 and heard.count("bad") == 2 and heard.count("flaky") == 2 and heard.count("") == 1


def test_one_provider_for_each_worker_process(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def make():
        import os
        import uuid

        (made / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda prompts: prompts

    provider.answer(spark.range(40).repartition(12).selectExpr("cast(id as string) as prompt"), make).collect()
    pids = [p.name.split("-")[0] for p in made.iterdir()]
    assert pids and len(pids) == len(set(pids))


def test_projects_are_fetched_once_and_failures_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def get(url, timeout):
        import uuid

        i = int(url.split("/")[-1])
        (log / f"{i}-{uuid.uuid4().hex}").touch()
        if i == 3 and len(list(log.glob("3-*"))) == 1:
            raise OSError("down")
        return "application/json", json.dumps({"targets": [], "n": i})

    path, asked = f"file://{tmp_path}/projects", lambda i: len(list(log.glob(f"{i}-*")))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "project_id long")
    one = {r.project_id: r for r in fetch.fetch_missing(ids(1, 2, 2, 3), path, "m", "p", get=get, partitions=2).collect()}
    assert set(one) == {1, 2, 3} and one[3].json is None and "down" in one[3].error and json.loads(one[2].json)["n"] == 2
    two = {r.project_id: r.error for r in fetch.fetch_missing(ids(2, 3, 4), path, "m", "p", get=get).collect()}
    assert two == {2: None, 3: None, 4: None} and [asked(i) for i in (1, 2, 3, 4)] == [1, 1, 2, 1]
    source = f"file://{tmp_path}/ids"
    ids(4, 5).write.parquet(source)
    for more in (None, 6):
        if more:
            ids(more).write.mode("append").parquet(source)
        stream = spark.readStream.schema("project_id long").parquet(source)
        fetch.stream_projects(stream, path, f"file://{tmp_path}/check", "m", "p", available_now=True, get=get).awaitTermination(60)
    assert [asked(i) for i in (4, 5, 6)] == [1, 1, 1] and store.best(spark.read.parquet(path), "project_id").filter("error is null").count() == 6


def test_pace():
    seen = []
    send = fetch.paced(lambda url, timeout: (seen.append((url, time.monotonic())), ("", ""))[1], per_second=20)
    for url in ("http://a/1", "http://b/1", "http://a/2", "http://a/3"):
        send(url, 1.0)
    at = [t for u, t in seen if "//a/" in u]
    assert at[1] - at[0] > 0.04 and at[2] - at[1] > 0.04
