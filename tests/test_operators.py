"""Evaluation, retrieval, parsing, prompts and entry plans against plain versions."""

import json
import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import parse, prompt, provider
from tallyloom.operators import evaluate as ev
from tallyloom.operators import retrieve as rt
from tallyloom.plans import loocv
from tallyloom.plans.dims import DIMENSIONS, FEATURES, FLAG_FEATURES
from tallyloom.sources import fetch, service
from tallyloom.sources.files import load_map, save_map


def facts(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, dimension string, actual int, predicted int")


def test_perfect_predictions(spark):
    df = facts(spark, [(i, d, 3, 3) for i in (1, 2) for d in DIMENSIONS])
    r = ev.summary(df).first()
    assert (r.num_samples, r.num_dimensions, r.accuracy, r.kappa, r.macro_f1) == (2, 20, 100.0, 1.0, pytest.approx(1 / 6))
    assert set(r.mae_by_dimension.values()) == {0.0}
    with pytest.raises(ValueError):
        ev.summary(df.limit(0))


def test_confusion_map_and_remap(spark, tmp_path):
    df = facts(spark, [(1, "loops", 2, 1), (2, "loops", 3, 1), (3, "loops", 3, 1), (4, "loops", 5, 4), (5, "loops", 4, 4), (6, "loops", 0, None)])
    m = ev.confusion_map(df)
    assert {(r.predicted, r.remapped) for r in m.collect()} == {(1, 3), (4, 5), (None, 0)}
    save_map(m, str(tmp_path / "map"))
    again = load_map(spark, str(tmp_path / "map"))
    assert load_map(spark, str(tmp_path / "none")).count() == 0
    out = {r.sample_id: r.predicted for r in ev.remap(df.union(facts(spark, [(7, "loops", 1, 2)])), again).collect()}
    assert out == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5, 6: 0, 7: 2}


def test_votes(spark):
    cases = {1: [3, 3, 1], 2: [1, 2, 4], 3: [0, 4, 4, 0], 4: [2, 3], 5: [5]}
    df = spark.createDataFrame([(s, "loops", i, v) for s, vs in cases.items() for i, v in enumerate(vs)], "sample_id long, dimension string, pass int, predicted int")

    def plain(values):
        most = max(values.count(v) for v in values)
        mean = statistics.mean(values)
        return min((v for v in set(values) if values.count(v) == most), key=lambda v: (abs(v - mean), v))

    assert {r.sample_id: r.predicted for r in ev.vote(df).collect()} == {s: plain(v) for s, v in cases.items()}
    assert {r.sample_id: r.predicted for r in ev.vote(df, "median").collect()} == {s: round(statistics.median(v)) for s, v in cases.items()}
    assert {r.sample_id: r.predicted for r in ev.vote(df, "mean").collect()} == {s: round(statistics.mean(v)) for s, v in cases.items()}


def test_labels(spark):
    sheet = spark.createDataFrame([(5, "https://x/projects/77/editor", "4.9", None), (6, None, "x", "2"), (None, "nothing", "1", "1")], "`ID` long, URL string, `1.Decomp` string, `2.Sequencing` string")
    got = {(r.project_id, r.dimension): r.actual for r in ev.label_grades(sheet).collect()}
    assert len(got) == 40 and got[77, "problem_decomposition"] == 4 and got[77, "sequencing"] == 0 and got[6, "problem_decomposition"] == 0 and got[6, "sequencing"] == 2


def records(n=24):
    out = []
    for i in range(n):
        f = {"sprite_count": i % 7, "block_count": (i * 37) % 200, "variable_count": i % 4, "list_count": i % 3} | {c: (i * (k + 3)) % 5 < 2 for k, c in enumerate(FLAG_FEATURES)}
        out.append((i, 100 + i, *f.values(), [(i * (d + 6) + d * d) % 6 for d in range(20)]))
    return out


def frame(spark, rows):
    kinds = ", ".join(f"{c} {'boolean' if c in FLAG_FEATURES else 'int'}" for c in FEATURES)
    return spark.createDataFrame(rows, f"pos long, id long, {kinds}, grades array<int>")


def alike(a, b):
    a, b = dict(zip(FEATURES, a[2:21], strict=True)), dict(zip(FEATURES, b[2:21], strict=True))
    near = lambda c: 1 - abs(a[c] - b[c]) / max(a[c], b[c], 1)
    s = sum(2.0 for c in FLAG_FEATURES if a[c] == b[c]) + sum(near(c) for c in FEATURES[:4])
    s += sum(1.8 for c in ("uses_loops", "uses_conditionals", "uses_algorithms", "uses_nesting", "uses_math") if a[c] == b[c]) + near("block_count")
    s += sum(2.0 for c in ("uses_event_handling", "uses_messaging", "uses_ui_feedback") if a[c] == b[c]) + 1.1 * near("sprite_count")
    return s + sum(1.7 for c in ("uses_variables", "uses_lists", "uses_math") if a[c] == b[c]) + near("variable_count") + near("list_count")


def band(r):
    f = dict(zip(FEATURES, r[2:21], strict=True))
    s = f["sprite_count"] * 1.2 + f["block_count"] / 25 + f["variable_count"] * 1.5 + f["list_count"] * 2 + 2.2 * sum(f[c] for c in FLAG_FEATURES)
    return 0 if s < 28 else 1 if s < 52 else 2


def plain_mmr(rows, test, k):
    rest = [r for r in rows if r is not test]
    least = min(len(rest), max(2 * k, k + 2))
    pool = rest
    for far in (0, 1):
        near = [r for r in rest if abs(band(r) - band(test)) <= far]
        if len(near) >= least:
            pool = near
            break
    top = sorted((alike(r, test) for r in pool), reverse=True)[:8]
    mean = sum(top) / len(top)
    cv = statistics.pstdev(top) / mean if mean else 0
    w = 0.62 if cv <= 0.12 else 0.84 if cv >= 0.35 else 0.62 + 0.22 * (cv - 0.12) / 0.23
    w = min(0.9, w + 0.04) if mean < 12 else w
    chosen = []
    while len(chosen) < k:
        worth = lambda r: w * alike(r, test) + (1 - w) * min((sum(abs(x - y) for x, y in zip(r[-1], c[-1], strict=True)) / 20 for c in chosen), default=0)
        chosen.append(max((r for r in pool if r not in chosen), key=lambda r: (round(worth(r), 9), -r[0])))
    return [r[1] for r in chosen]


def test_greedy_choices_against_plain_versions(spark):
    rows = records()
    df = frame(spark, rows)
    got = {}
    for r in rt.mmr_examples(df, df, 3).collect():
        got.setdefault(r.test_pos, {})[r.rank] = r.id
    assert {t: [x[k] for k in sorted(x)] for t, x in got.items()} == {r[0]: plain_mmr(rows, r, 3) for r in rows}

    def worth(chosen):
        cover = [{r[-1][d] for r in chosen} for d in range(20)]
        return 100 * sum(len(c) == 5 for c in cover) + sum(map(len, cover))

    chosen = []
    for _ in range(4):
        chosen.append(max((r for r in rows if r not in chosen), key=lambda r: (worth([*chosen, r]), -r[0])))
    assert [r.id for r in rt.balanced_examples(df, 4).collect()] == sorted(r[1] for r in chosen)
    assert rt.balanced_examples(df, 99).count() == len(rows)
    picked = rt.contrastive_examples(df, "loops", 5, seed=1).collect()
    scores = sorted({r[-1][2] for r in rows})
    low = set(scores[: len(scores) // 2 + 1])
    assert len(picked) == 5 and sum(r.grades[2] in low for r in picked) == 3 and [r.id for r in picked] == sorted(r.id for r in picked)


RESPONSES = [
    ('x\n```json\n{"loops": 3, "math": 2.9}\n```', {"loops": 3, "math": 2}),
    ('{"loops": -2.7, "a": true, "b": "4", "c": null, "d": [1]} end', {"loops": -2, "a": 1}),
    ('```\nnot json\n```\n{"lists": 1}', {"lists": 1}),
    ('```{"a": 1}``` ```{"a": 2}```', {"a": 1}),
    ('{"a": 1} and {"b": 2}', {}),
    ("[1]", {}),
    ("", {}),
    (None, {}),
    ('{"a":', {}),
]


def test_parsing(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RESPONSES)], "k int, response string")
    got = {i: {} for i in range(len(RESPONSES))}
    for r in parse.grades(df, "k").collect():
        got[r.k][r.dimension] = r.grade
    assert got == {i: want for i, (_, want) in enumerate(RESPONSES)}
    s = {r.k: (r.s.json, r.s.error) for r in df.select("k", parse.sanitize(F.col("response")).alias("s")).collect()}
    assert s[4] == ('{"b":2}', None) and s[5] == ("[1]", None) and s[7] == (None, "no_text") and s[8] == (None, "no_json_found") and s[6][1] == "no_json_found"
    c = spark.createDataFrame([('{"error": "x"}',), ('{"prob": 0.5}',), ('{"error": "", "a": 1}',), ("[]",), ('{"score": "y", "prob": 0.25}',)], "t string")
    assert [r.c for r in c.select(parse.confidence(F.col("t")).alias("c")).collect()] == [0.0, 0.5, 1.0, 0.0, 0.25]


def test_prompts(spark):
    rows = records(3)
    df = frame(spark, rows)
    own = F.struct(*FEATURES)
    one = df.filter("pos = 2").select(own.alias("features"), F.lit(1).alias("x")).join(df.filter("pos = 0").select(F.array(F.struct(own.alias("features"), "grades")).alias("examples"), F.lit(1).alias("x")), "x")
    f, e = F.col("features"), F.col("examples")
    r = one.select(prompt.few_shot(f, e).alias("few"), prompt.chain_of_thought(f, e).alias("cot"), prompt.hybrid(f, e).alias("hybrid"), prompt.category(f, e, "state_data").alias("cat")).first()
    lines = "\n".join(f"  {c}: {v}" for c, v in zip(FEATURES, rows[2][2:21], strict=True))
    grades = "\n".join(f"  {d}: {v}" for d, v in zip(DIMENSIONS, rows[0][-1], strict=True))
    first = "\n".join(f"  {c}: {v}" for c, v in zip(FEATURES, rows[0][2:21], strict=True))
    assert r.few == f"Example 1:\nFeatures:\n{first}\nGrades:\n{grades}\n\nNow grade this new project:\nFeatures:\n{lines}\n\nReturn only the grades as a JSON object with the same rubric keys."
    assert "Reasoning:\n  - The project has 0 sprite(s)" in r.cot and "Think step-by-step" in r.cot and f"debugging ({rows[0][-1][6]})" in r.cot
    assert r.hybrid.startswith("RUBRIC SUMMARY (Levels 1–5):") and "EVIDENCE-FIRST" in r.hybrid and json.dumps(DIMENSIONS) in r.hybrid
    assert r.cat.startswith("CATEGORY: STATE_DATA") and "  loops:" not in r.cat.split("Now grade")[0] and "  - lists:" in r.cat
    with pytest.raises(ValueError):
        prompt.category(f, e, "nothing")


def test_leave_one_out(spark):
    df = frame(spark, records(5))
    out = loocv.leave_one_out(df, loocv.Settings(num_examples=2, passes=1, calibration="v1", blend_weight=0.2)).collect()
    assert len(out) == 100 and all(0 <= r.predicted <= 5 for r in out) and {r.sample_id for r in out} == {100, 101, 102, 103, 104}
    with pytest.raises(ValueError):
        loocv.leave_one_out(df, loocv.Settings(num_examples=0))
    with pytest.raises(ValueError):
        loocv.leave_one_out(df.limit(1))


def test_leave_one_out_takes_no_table_of_records_through_the_driver(spark, monkeypatch):
    plans, plain = [], loocv.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(loocv, "cut", lambda df: plans.append(plan(df)) or plain(df))
    plans.append(plan(loocv.leave_one_out(frame(spark, records(6)), loocv.Settings(num_examples=2, passes=2))))
    assert len(plans) == 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_a_record_is_graded_with_the_first_others(spark):
    rows = records(5)
    got = {r.test_pos: [(e["rank"], e.pos, e.features.block_count) for e in r.examples] for r in rt.with_first_examples(frame(spark, rows), 2).collect()}
    blocks = {r[0]: r[3] for r in rows}
    want = {p: [(i, q, blocks[q]) for i, q in enumerate([q for q in range(5) if q != p][:2], 1)] for p in range(5)}
    assert got == want


def test_fetch_and_service(spark):
    def get(url, timeout):
        if url.endswith("/1"):
            return "application/json", '{"project_token": "t"}'
        if url.endswith("/1?token=t"):
            return "application/octet-stream", '{"targets": []}'
        if url.endswith("/2"):
            return "text/html", "{}"
        raise OSError("no")

    got = {r.project_id: r for r in fetch.fetch_projects(spark.createDataFrame([(1,), (2,), (3,)], "project_id long"), "m", "p", get).collect()}
    assert got[1].json == '{"targets": []}' and got[2].json is None and "OSError" in got[3].error
    assert service.respond("{", None)[0] == 400 and service.respond("{}", None)[0] == 400
    status, answer = service.respond('{"url": "u"}', lambda url, request: ("f", {"loops": 1}))
    assert status == 200 and set(answer) == {"status", "url", "prompt_path", "grades"} and service.project_id("a/projects/12/") == 12
    assert "loops" in json.loads(provider.fixed_answers()(["x"])[0])


def test_stream_equals_batch(spark, tmp_path):
    from tallyloom.plans.corpus import block_rows
    from tallyloom.streaming.features import windowed_features

    rows = block_rows(spark, "/root/testdata/sf0.001").select("project_id", "opcode", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_features(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    try:
        q.processAllAvailable()
        assert sorted(map(str, spark.table("windowed").collect())) == sorted(map(str, windowed_features(rows).collect()))
    finally:
        q.stop()


def raw_projects(spark):
    block = {"a": {"opcode": "event_whenflagclicked", "parent": None}, "b": {"opcode": "control_repeat", "parent": "a"}}
    rows = [(7, json.dumps({"targets": [{"isStage": False, "name": "Cat", "blocks": block}]})), (8, '{"targets": []}'), (9, "{}"), (10, None)]
    return spark.createDataFrame(rows, "project_id long, json string")


def test_enrich_gives_a_record_for_each_row_in_order(spark):
    rows = [(8, None, "2"), (None, "https://x/projects/7/", "3"), (9, None, "1"), (10, None, "1"), (99, None, "1"), (None, None, "1"), (7, None, None), (7, "https://x/projects/8", "5.9")]
    sheet = spark.createDataFrame(rows, "ID long, URL string, `1.Decomp` string")
    got = loocv.enrich(sheet, raw_projects(spark)).orderBy("pos").collect()
    assert [(r.pos, r.id, r.grades[0], r.block_count) for r in got] == [(0, 8, 2, 0), (1, 7, 3, 2), (2, 7, 0, 2), (3, 8, 5, 0)]
    assert got[1].uses_loops and got[1].model_scores.loops == 2 and all(sum(r.grades[1:]) == 0 for r in got)
    one = ev.summary(loocv.stored_facts(loocv.enrich(sheet, raw_projects(spark)))).first()
    assert (one.num_samples, one.num_dimensions) == (4, 20)


def test_the_first_records_make_a_prompt(spark):
    rows = records(5)
    df = frame(spark, rows)
    two = prompt.of_records(df, 2).first()
    assert two.id == rows[2][1] and "Example 2:" in two.prompt and "Example 3:" not in two.prompt
    assert prompt.of_records(df, 9, "hybrid").first().id == rows[4][1]
    for bad in (df.limit(1), df.limit(0)):
        with pytest.raises(ValueError):
            prompt.of_records(bad, 2)


def test_server_answers(spark):
    texts = ['```json\n{"a": "x", "b": [1]}\n```', "  no json \n", "", None, "[1] {", '{"c": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.a and json.loads(r.a) for r in df.select("k", parse.server_answer(F.col("t")).alias("a")).collect()}
    assert got == {0: {"a": "x", "b": [1]}, 1: {"raw_response": "no json"}, 2: None, 3: None, 4: {"raw_response": "[1] {"}, 5: {"c": None}}


def test_a_request_is_fetched_prompted_and_graded(spark, tmp_path):
    from tallyloom.plans.grading import Grader

    asked = []

    def get(url, timeout):
        return "application/json", '{"project_token": "t"}' if "token" not in url else '{"targets": [{"name": "Cat"}]}'

    def said(model, request):
        return lambda prompts: asked.append((model, prompts)) or [request.get("say", 'Sure: {"loops": 3}')]

    grade = Grader(frame(spark, records(4)), "m", "p", f"{tmp_path}/prompt.txt", {"stub": said}, "stub", get)
    status, answer = service.respond('{"url": "https://x/projects/5", "prompt_style": "question_based", "model": "big"}', grade)
    assert status == 200 and answer["grades"] == {"loops": 3} and asked[0][0] == "big"
    text = open(answer["prompt_path"], encoding="utf-8").read()
    assert text == asked[0][1][0] and text.startswith("QUESTION GUIDE") and "Example 3:" in text and "  sprite_count: 1" in text.split("Now grade")[1]
    assert service.respond('{"url": "https://x/projects/5", "say": "hm"}', grade)[1]["grades"] == {"raw_response": "hm"}
    assert service.respond('{"url": "https://x/projects/5", "say": ""}', grade)[1]["grades"] is None
    assert service.respond('{"url": "https://x/y"}', grade)[0] == 500 and service.respond('{"url": "https://x/projects/5", "provider": "none"}', grade)[0] == 500


def test_a_local_model_says_what_it_lacks():
    try:
        import torch  # noqa: F401
        import transformers  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="torch"):
            provider.local_provider("some/model")()


def test_the_last_of_repeated_projects_is_written(spark, tmp_path):
    from tallyloom.sources.files import write_stages

    df = spark.createDataFrame([(1, "old"), (2, "one"), (1, "new")], "project_id long, v string").coalesce(1)
    paths = write_stages(df, df, df, str(tmp_path))
    assert {(r.project_id, r.v) for r in spark.read.parquet(paths["raw_projects_path"]).collect()} == {(1, "new"), (2, "one")}


def test_json_depth_has_no_cap(spark):
    from tallyloom.operators.features import json_depth

    texts = ["[" * 500 + "]" * 500, '{"a": "' + "x" * 100_000 + '\\\\"}', "", '"["', '[{"a": []}, []]']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d for r in df.select(json_depth(F.col("t")).alias("d")).collect()] == [500, 1, 0, 0, 3]


def test_facts_and_votes_of_a_small_file_are_made_by_many_tasks(spark, monkeypatch):
    from tallyloom.plans import corpus

    monkeypatch.setattr(corpus, "SPREAD_ROWS", 20)
    facts = corpus.grade_facts(spark, "/root/testdata/sf0.001")
    n = facts.select("sample_id").distinct().count()
    assert facts.rdd.getNumPartitions() == -(-n // 20)
    sizes = facts.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 20 * 20 * 3
    voted = ev.vote(corpus.pass_facts(spark, "/root/testdata/sf0.001"))
    assert voted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # each task groups its own samples
    assert voted.count() == 20 * n
