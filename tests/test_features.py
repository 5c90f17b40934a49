"""Parsing, features, answers and scores of projects, the reference scenarios among them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import features as fe
from tallyloom.operators import scoring as sc
from tallyloom.operators.graph import control_depth
from tallyloom.operators.rubric import LADDERS, QUESTIONS
from tallyloom.plans.dims import CATEGORIES, DIMENSIONS
from tallyloom.sources.projects import parse_projects


def block(opcode, parent=None, **fields):
    return {"opcode": opcode, "parent": parent, "fields": fields}


SIX = {
    "targets": [
        {"isStage": True, "name": "Stage", "blocks": {}},
        {
            "isStage": False,
            "name": "Sprite1",
            "variables": {"v1": ["score", 0]},
            "lists": {},
            "sounds": [{"name": "pop"}],
            "costumes": [{"name": "a"}, {"name": "b"}],
            "blocks": {
                "a": block("event_whenflagclicked"),
                "b": block("control_repeat", "a"),
                "c": block("control_if", "b"),
                "d": block("data_setvariableto", "c"),
                "e": block("motion_gotoxy", "d"),
                "f": block("event_broadcast", "e", BROADCAST_OPTION=["message1", "id"]),
            },
        },
    ]
}


def project(spark, *texts):
    return parse_projects(spark.createDataFrame(list(enumerate(texts)), "project_id long, json string"))


def rows(df):
    return {r.project_id: r for r in df.collect()}


def test_six_block_project(spark):
    p = project(spark, json.dumps(SIX))
    f = rows(fe.project_features(p))[0]
    assert (f.sprite_count, f.block_count, f.variable_count, f.list_count) == (1, 6, 1, 0)
    assert f.uses_loops and f.uses_conditionals and f.uses_variables and f.uses_messaging and f.uses_nesting and f.uses_integration
    assert f.uses_sound and f.uses_animation and f.uses_algorithms and not f.uses_lists and not f.uses_cloning
    c = rows(fe.project_context(p))[0]
    assert c.max_control_nesting_depth == 2 and c.nested_control_count == 1 and c.broadcast_name_count == 1 and c.descriptive_broadcast_count == 0
    a = rows(fe.atomic_answers(fe.project_context(p)))[0]
    assert a.variables.variables_used and a.ui_feedback.score_lives_timer_shown and not a.sound.sounds_used and not a.animation.costume_changes_used
    assert not a.event_handling.handlers_attached_to_correct_sprites and a.nesting.nesting_correct
    scored = rows(sc.scores(fe.atomic_answers(fe.project_context(p))))[0]
    assert all(1 <= scored[d] <= 5 for d in DIMENSIONS if d not in ("debugging", "integration"))


def test_empty_odd_and_broken_projects(spark):
    odd = {
        "targets": [
            {"name": "Legend", "variables": {"x": []}, "comments": {"c": {"text": "Fix me"}, "d": {"text": ""}}, "blocks": {"p": [12, "x", "id"], "q": block("sound_play"), "r": block("event_broadcast", None, BROADCAST_OPTION="no list")}},
            {"isStage": True, "name": None, "blocks": None},
        ]
    }
    p = project(spark, json.dumps({"targets": []}), json.dumps(odd), None, "", "{}", "not json", '{"targets": [{"blocks": {"a": ', '{"targets": null}')
    f = rows(fe.project_features(p))
    assert len(f) == 8 and all(f[i].block_count == 0 and not f[i].uses_sound for i in (0, 2, 3, 4, 5, 6, 7))
    assert f[1].block_count == 2 and f[1].sprite_count == 1 and f[1].uses_sound and f[1].variable_count == 1 and f[1].uses_variables
    c = rows(fe.project_context(p))[1]
    assert c.screen_target and c.named_target and c.comment_fix and not c.comment_debug and c.variable_name_count == 0 and c.broadcast_name_count == 0
    errors = {r.project_id: r.parse_error for r in p.projects.collect()}
    assert errors[5] and not errors[0] and not errors[2] and not errors[4]


def test_parts_of_the_wrong_kind_are_passed_over(spark):
    odd = (
        '{"targets":[1,null,{"name":5,"isStage":"x","blocks":{"a":[1],"b":{"opcode":7,"parent":null,"fields":{}},"c":null,"d":"s",'
        '"e":{"opcode":"event_broadcast","fields":{"BROADCAST_OPTION":["m",null]}},"f":{"opcode":"event_broadcast","fields":{"BROADCAST_OPTION":"m"}}},'
        '"variables":{"v":["score",0],"w":"x","y":[]},"lists":[1],"sounds":[1,2],"costumes":{},"comments":{"c":{"text":"hi"},"d":"no"}}]}'
    )
    p = project(spark, odd, '{"targets":{}}', "[1]", "nonsense", '{"a":1,"a":2}', "", "{}", '{"targets":null}')
    assert [r.parse_error for r in p.projects.orderBy("project_id").collect()] == [False, False, True, True, True, False, False, False]
    (t,) = p.targets.collect()
    assert (t.target_idx, t.target_name, t.is_stage, t.variables, t.lists, t.sounds, t.costumes) == (2, "5", False, 3, 0, 2, 0)
    assert sorted((r.block_id, r.opcode, r.parent_id, r.broadcast_name) for r in p.blocks.collect()) == [("b", "7", None, None), ("e", "event_broadcast", None, "m"), ("f", "event_broadcast", None, None)]
    assert [(r.kind, r.name) for r in p.names.collect()] == [("variable", "score")] and [r.text for r in p.comments.collect()] == ["hi"]


def chain(n, opcode="control_if"):
    return {str(i): block(opcode, str(i - 1) if i else None) for i in range(n)}


def test_depth_of_long_chains_and_cycles(spark):
    ring = {"a": block("control_if", "b"), "b": block("control_if", "a"), "c": block("motion_movesteps")}
    p = project(spark, json.dumps({"targets": [{"name": "x", "blocks": chain(300)}]}), json.dumps({"targets": [{"name": "x", "blocks": ring}]}), json.dumps({"targets": [{"name": "x", "blocks": {"a": block("control_repeat_until", "gone")}}]}))
    deep = control_depth(p.blocks).groupBy("project_id").agg(F.max("depth").alias("d"), F.count_if("nested").alias("n"), F.max("cyclic").alias("c"))
    got = {r.project_id: r for r in deep.collect()}
    assert (got[0].d, got[0].n, got[0].c) == (299, 299, False)
    assert got[1].c and not got[2].c and (got[2].d, got[2].n) == (0, 0)


def test_depth_by_either_way(spark):
    """Walked or doubled, with repeated and missing ids, cycles with tails, and targets of one name in two projects."""
    draw = random.Random(4)
    rows = []
    for project in (1, 2, 3, None):
        for target in (0, 1):
            n = draw.choice([1, 6, 40])
            for b in range(n):
                opcode = draw.choice(["control_if", "control_repeat_until", "motion_movesteps", None])
                rows.append((project, target, draw.choice([str(b), str(b), str(b), None]), opcode, draw.choice([str(draw.randrange(n)), str(max(0, b - 1)), "gone", None])))
    rows += rows[:5]
    blocks = spark.createDataFrame(rows, "project_id long, target_idx int, block_id string, opcode string, parent_id string")

    def plain(row):
        own = sorted((r for r in rows if r[:2] == row[:2] and r[2] is not None), key=lambda r: [(x is not None, x or "") for x in (r[3], r[4])])
        first = {r[2]: r for r in reversed(own)}
        control = lambda r: (r[3] or "").startswith(("control_repeat", "control_forever", "control_if"))
        depth, seen, at = 0, set(), row
        while at[4] in first:
            at = first[at[4]]
            if at[2] in seen:
                return 0, control(row) and control(first[row[4]]), True
            seen.add(at[2])
            depth += control(at)
        return depth, row[4] in first and control(row) and control(first[row[4]]), False

    want = sorted((str((*r, *plain(r))) for r in rows))
    assert sorted(str(tuple(r)) for r in control_depth(blocks).collect()) == want
    known = [r for r in rows if r[0] is not None]
    doubled = control_depth(blocks.filter("project_id is not null"), large=5, small_bytes=0)
    assert sorted(str(tuple(r)) for r in doubled.collect()) == sorted(str((*r, *plain(r))) for r in known)


E1 = ["events_beyond_green_flag", "handlers_attached_to_correct_sprites"]
E2 = [*E1, "multiple_event_types_handled", "sprites_react_independently"]
M3 = ["broadcasts_used", "sprites_respond_correctly", "messaging_architecture_clear", "multi_sprite_interactions_coordinated"]
LADDER_CASES = [
    ("debugging", [], 0), ("debugging", ["fixes_documented"], 1), ("debugging", ["fixes_documented", "edge_cases_tested", "debugging_comments_present"], 2),
    ("integration", [], 0),
    ("conditionals", [], 1), ("conditionals", ["boolean_conditions_correct"], 2), ("conditionals", ["boolean_conditions_correct", "if_else_used"], 3),
    ("conditionals", ["boolean_conditions_correct", "if_else_used", "compound_conditions_used", "conditional_logic_clean"], 4),
    ("variables", [], 1), ("variables", ["variables_used"], 2), ("variables", ["variables_used", "variables_initialized"], 2),
    ("variables", ["variables_used", "variables_initialized", "variable_names_descriptive"], 3),
    ("variables", ["variables_used", "variables_initialized", "multiple_states_tracked", "variables_updated_on_events"], 3),
    ("variables", ["variables_used", "variables_initialized", "multiple_states_tracked", "variables_updated_on_events", "coherent_variable_system"], 4),
    ("event_handling", [], 1), ("event_handling", E1, 2), ("event_handling", E2, 3), ("event_handling", [*E2, "event_names_descriptive", "event_conflicts_avoided"], 5),
    ("messaging", [], 1), ("messaging", ["broadcasts_used"], 2), ("messaging", ["broadcasts_used", "sprites_respond_correctly"], 2),
    ("messaging", ["broadcasts_used", "sprites_respond_correctly", "messages_differently_named"], 3), ("messaging", M3, 4),
    ("messaging", [*M3, "messages_differently_named", "circular_dependencies_avoided"], 5),
    ("ui_feedback", [], 1), ("ui_feedback", ["ui_clear_and_readable"], 2), ("ui_feedback", ["ui_clear_and_readable", "ui_updates_in_real_time", "feedback_messages_used"], 3),
    ("ui_feedback", ["start_end_screens_present", "score_lives_timer_shown"], 4),
    ("coordinates", [], 1), ("coordinates", ["positions_updated_dynamically"], 3), ("coordinates", ["positions_updated_dynamically", "boundaries_checked"], 4),
    ("problem_decomposition", [], 1), ("problem_decomposition", ["has_subproblems"], 2), ("problem_decomposition", ["has_subproblems", "clear_boundaries"], 3),
    ("problem_decomposition", ["has_subproblems", "has_hierarchy", "dependencies_explicit"], 4),
    ("nesting", [], 1), ("nesting", ["loops_nested"], 2), ("nesting", ["loops_nested", "nesting_correct", "nesting_serves_clear_purpose"], 2),
    ("nesting", ["loops_nested", "conditionals_nested", "nesting_correct", "nesting_serves_clear_purpose"], 3),
    ("nesting", ["loops_nested", "nesting_correct", "nesting_serves_clear_purpose", "nested_systems_used"], 4),
    ("procedures", [], 1), ("procedures", ["custom_blocks_used"], 2), ("procedures", ["custom_blocks_used", "custom_blocks_have_parameters"], 3),
    ("procedures", ["custom_blocks_used", "custom_blocks_reused", "complex_behaviors_abstracted"], 4),
    ("animation", [], 1), ("animation", ["costume_changes_used"], 2), ("animation", ["costume_changes_used", "animations_loop_smoothly"], 3),
    ("animation", ["costume_changes_used", "multiple_animation_states_used", "transitions_smooth"], 4),
    ("algorithms", [], 1), ("algorithms", ["step_by_step_strategy"], 2), ("algorithms", ["step_by_step_strategy", "algorithm_works_for_inputs"], 3),
    ("algorithms", ["step_by_step_strategy", "algorithm_works_for_inputs", "efficiency_considered", "edge_cases_handled"], 4),
    ("lists", [], 1), ("lists", ["lists_used"], 2), ("lists", ["lists_used", "list_operations_used"], 2), ("lists", ["lists_used", "list_operations_used", "lists_updated_during_gameplay"], 3),
    ("lists", ["lists_used", "list_operations_used", "lists_processed_with_loops", "lists_updated_during_gameplay"], 4),
    ("lists", ["lists_used", "list_operations_used", "lists_processed_with_loops", "lists_updated_during_gameplay", "list_items_accessed_dynamically", "list_based_systems_designed"], 5),
    ("sequencing", [], 1), ("sequencing", ["logical_order"], 2), ("sequencing", ["logical_order", "optimized_order"], 3),
    ("sequencing", ["logical_order", "optimized_order", "clear_start_to_finish_flow"], 4), ("sequencing", list(QUESTIONS["sequencing"])[:4], 5),
    ("loops", ["loops_nested"], 2), ("loops", list(QUESTIONS["loops"])[:2], 3), ("loops", list(QUESTIONS["loops"])[:3], 4), ("loops", list(QUESTIONS["loops"])[:4], 5),
]


FLAGS = [f"uses_{k}" for k in "loops conditionals variables event_handling cloning collision animation sound ui_feedback lists math messaging algorithms nesting integration".split()]
BASE = {"sprite_count": 3, "block_count": 50, "variable_count": 1, "list_count": 0} | dict.fromkeys(FLAGS, True)
SCHEMA = (
    "project_id int, " + ", ".join(f"{k} {'boolean' if k in FLAGS else 'int'}" for k in BASE)
    + ", " + ", ".join(f"{d} struct<{', '.join(f'{q}:boolean' for q in qs)}>" for d, qs in QUESTIONS.items())
    + ", " + ", ".join(f"p_{d} double" for d in DIMENSIONS)
)


def frame(spark, cases):
    """One row per case of (features, answers, predictions), each over a plain base."""
    rows = []
    for i, (features, answered, given) in enumerate(cases):
        structs = [tuple(q in answered.get(d, []) for q in qs) for d, qs in QUESTIONS.items()]
        predictions = [None if given.get(d, 3) is None else float(given.get(d, 3)) for d in DIMENSIONS]
        rows.append((i, *(BASE | features).values(), *structs, *predictions))
    return spark.createDataFrame(rows, SCHEMA)


def by_case(df):
    return {r.project_id: r for r in df.select("project_id", *("p_" + d for d in DIMENSIONS)).collect()}


def test_every_ladder_branch(spark):
    got = rows(sc.scores(frame(spark, [({}, {d: true}, {}) for d, true, _ in LADDER_CASES])))
    for i, (d, true, want) in enumerate(LADDER_CASES):
        assert got[i][d] == want, (d, true)


def test_rubric_tables_fit_together():
    assert len(DIMENSIONS) == 20 and sum(map(len, QUESTIONS.values())) == 119 and list(QUESTIONS) == DIMENSIONS
    assert sorted(d for c in CATEGORIES.values() for d in c) == sorted(DIMENSIONS) and set(LADDERS) < set(DIMENSIONS)


CALIBRATIONS = [
    ("off", {"uses_sound": False}, {"sound": 3}, {"sound": 3}),
    ("v1", {"uses_sound": False}, {"sound": 3}, {"sound": 2}),
    ("v1", {"uses_sound": False}, {"sound": 4}, {"sound": 4}),
    ("anything", {"block_count": 79}, {"loops": 3, "algorithms": 5}, {"loops": 3, "algorithms": 5}),
    ("v1", {"uses_animation": False}, {"animation": 3}, {"animation": 3}),
    ("v2", {"uses_animation": False}, {"animation": 3}, {"animation": 2}),
    ("v2", {"sprite_count": 1}, {"messaging": 3, "integration": 3}, {"messaging": 1, "integration": 2}),
    ("v2", {"block_count": 44}, {"nesting": 3, "procedures": 3}, {"nesting": 1, "procedures": 2}),
    ("v2", {"block_count": 24}, {"loops": 3}, {"loops": 2}),
]


def test_calibration(spark):
    for mode in ("off", "v1", "anything", "v2"):
        own = [c for c in CALIBRATIONS if c[0] == mode]
        got = by_case(sc.calibrate(frame(spark, [(f, {}, g) for _, f, g, _ in own]), mode))
        for i, (_, f, g, want) in enumerate(own):
            assert {d: got[i]["p_" + d] for d in want} == want, (mode, f, g)


STEADY = {d: list(q) for d, q in QUESTIONS.items()}


CONSTRAINTS = [
        ({}, {}, {"loops": 2.5, "math": 3.5, "sound": 9}, {"loops": 2, "math": 4, "sound": 5}),
        ({"uses_cloning": False}, {"cloning": []}, {"cloning": 4}, {"cloning": 0}),
        ({"uses_cloning": False}, {}, {"cloning": 4}, {"cloning": 4}),
        ({"uses_variables": False}, {"variables": []}, {"variables": 4}, {"variables": 1}),
        ({"uses_integration": False}, {"integration": []}, {"integration": 2}, {"integration": 0}),
        ({"block_count": 2}, {}, {"algorithms": 3, "sequencing": 4}, {"algorithms": 1, "sequencing": 2}),
        ({"block_count": 6}, {}, {"algorithms": 5, "sequencing": 5}, {"algorithms": 4, "sequencing": 4}),
        ({}, {"sequencing": ["optimized_order"], "event_handling": []}, {"sequencing": 5}, {"sequencing": 3}),
        ({}, {"problem_decomposition": []}, {"problem_decomposition": 5}, {"problem_decomposition": 2}),
        ({}, {"problem_decomposition": ["has_subproblems"]}, {"problem_decomposition": 5}, {"problem_decomposition": 4}),
        ({}, {"nesting": []}, {"nesting": 5}, {"nesting": 1}),
        ({}, {"nesting": ["loops_nested"]}, {"nesting": 5}, {"nesting": 3}),
        ({}, {"animation": ["costume_changes_used", "animations_loop_smoothly"]}, {"animation": 5}, {"animation": 4}),
        ({}, {"animation": ["costume_changes_used"]}, {"animation": 4}, {"animation": 3}),
        ({}, {"algorithms": ["step_by_step_strategy"]}, {"algorithms": 5}, {"algorithms": 4}),
        ({}, {"algorithms": []}, {"algorithms": 5}, {"algorithms": 2}),
        ({}, {"sequencing": ["logical_order"]}, {"sequencing": 5}, {"sequencing": 3}),
        ({}, {}, {"loops": None}, {"loops": None}),  # absent predictions stay absent
]


def test_hard_constraints(spark):
    got = by_case(sc.constrain(frame(spark, [(f, STEADY | without, given) for f, without, given, _ in CONSTRAINTS])))
    for i, (f, without, given, want) in enumerate(CONSTRAINTS):
        assert {d: got[i]["p_" + d] for d in want} == want, (f, without, given)


def test_complexity(spark):
    r = frame(spark, [({}, {}, {})]).select(sc.complexity_score().alias("s"), sc.complexity_band().alias("b")).first()
    assert r.s == pytest.approx(3 * 1.2 + 2 + 1.5 + 15 * 2.2) and r.b == 1


def test_small_helpers(spark):
    b = spark.createDataFrame([(1, 0, "control_create_clone_of", None), (1, 1, "data_setvariableto", "a"), (2, 0, "control_start_as_clone", None)], "project_id long, at int, opcode string, variable string")
    c = rows(fe.clone_handlers(b))
    assert (c[1].clone_create, c[1].clone_start, c[2].clone_create, c[2].clone_start) == (True, False, False, True)
    v = rows(fe.initialised_variables(b, "at", "variable"))
    assert (v[1].num_var_inited, v[1].var_names_sample, v[2].num_var_inited) == (1, ["a"], 0)
    d = spark.createDataFrame([('[{"a": [1, "]"]}]',), ("7",), ("{}",)], "t string").select(fe.json_depth(F.col("t")).alias("d"))
    assert [r.d for r in d.collect()] == [3, 0, 1]
