"""The programs, from files to published sets."""

import json

import pytest

from tallyloom import run
from tallyloom.plans import loocv
from tallyloom.plans.dims import DIMENSIONS, SHEET_COLUMNS
from tallyloom.sources import files


def project(blocks):
    return json.dumps({"targets": [{"isStage": True, "name": "Stage"}, {"name": "Cat", "blocks": {str(i): {"opcode": "control_repeat", "parent": str(i - 1) if i else None} for i in range(blocks)}}]})


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Records of four projects, one of them missing and one empty."""
    root = tmp_path_factory.mktemp("run")
    header = ["ID", "URL", "Reviewer", *SHEET_COLUMNS]
    rows = [[i, "", 1, *[(i + k) % 6 for k in range(len(SHEET_COLUMNS))]] for i in (1, 2, 3, 4, 5)]
    (root / "sheet.csv").write_text("\n".join(",".join(map(str, r)) for r in [header, *rows]) + "\n")
    (root / "projects.json").write_text("\n".join(json.dumps({"project_id": i, "json": project(i * 3) if i != 5 else "{}"}) for i in (1, 2, 4, 5)) + "\n")
    run.main(["enrich", f"file://{root}/sheet.csv", f"file://{root}/projects.json", f"file://{root}/records"])
    return root


def test_enrich_and_evaluate(spark, made):
    records = run.read_records(spark, f"file://{made}/records").orderBy("pos").collect()
    assert [(r.pos, r.id, r.block_count) for r in records] == [(0, 1, 3), (1, 2, 6), (2, 4, 12)]
    run.main(["evaluate", f"file://{made}/records", f"file://{made}/evaluated"])
    summary = {(r.metric, r.key): r.value for r in files.read_published(spark, f"file://{made}/evaluated", "summary").collect()}
    assert summary["num_samples", None] == 3 and summary["num_dimensions", None] == len(DIMENSIONS)


def test_leave_one_out_and_prompt_by_settings(spark, made):
    env = {"TALLYLOOM_NUM_EXAMPLES": "1", "TALLYLOOM_PASSES": "1", "TALLYLOOM_STORE": f"file://{made}/store", "TALLYLOOM_STYLE": "hybrid", "TALLYLOOM_WINDOW": "2"}
    for _ in range(2):
        run.main(["leave-one-out", f"file://{made}/records", f"file://{made}/held"], env)
    facts = files.read_published(spark, f"file://{made}/held", "facts")
    plain = loocv.leave_one_out(run.read_records(spark, f"file://{made}/records"), loocv.Settings(num_examples=1, passes=1, style="hybrid"))
    assert sorted(map(tuple, facts.collect())) == sorted(map(tuple, plain.collect())) and facts.count() == 3 * len(DIMENSIONS)
    assert spark.read.parquet(f"file://{made}/store").count() == 3
    run.main(["prompt", f"file://{made}/records", f"file://{made}/prompt"], env | {"TALLYLOOM_STYLE": "few_shot"})
    (row,) = files.read_published(spark, f"file://{made}/prompt", "prompt").collect()
    assert "Example 1:" in row.prompt and "Now grade this new project:" in row.prompt


def test_settings():
    s = run.settings_from({"TALLYLOOM_BATCHED": "yes", "TALLYLOOM_BLEND_WEIGHT": "0.25", "TALLYLOOM_LIMIT": "", "OTHER": "1"})
    assert (s.batched, s.blend_weight, s.limit, s.num_examples) == (True, 0.25, 0, 3)
    with pytest.raises(ValueError, match="unknown provider"):
        run.settings_from({"TALLYLOOM_PROVIDER": "none such"})
    with pytest.raises(SystemExit):
        run.main(["enrich"])
