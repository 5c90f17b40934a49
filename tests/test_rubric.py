"""The rubric's one table of rules against cases made by hand, and the fixed texts against their digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import prompt
from tallyloom.operators import features as fe
from tallyloom.operators.rubric import LADDERS, QUESTIONS
from tallyloom.plans import dims, guides

COUNTS = (
    "sprite_count block_count conditional_count if_else_count loop_count procedure_definition_count procedure_call_count costume_switch_count wait_count operator_count "
    "broadcast_send_count broadcast_receive_count nested_control_count max_control_nesting_depth event_type_count handler_count broadcast_name_count descriptive_broadcast_count "
    "variable_name_count list_name_count comment_count"
).split()
FLAGS = (
    "has_event has_other_event has_loop has_conditional has_data has_broadcast has_procedure has_coordinate has_absolute_move has_relative_move has_edge_bounce has_clone has_collision has_sound "
    "has_ui_feedback has_message has_data_list has_operator has_compound has_list_update has_list_access named_target screen_target named_variable named_list state_variable comment_part "
    "comment_debug comment_fix has_variable has_list"
).split()

# What a project shows beyond nothing, and every question that is then answered with yes.
CASES = [
    ({}, ""),
    ({"sprite_count": 1, "block_count": 9}, "sequencing.logical_order"),
    ({"sprite_count": 2}, "problem_decomposition.has_subproblems problem_decomposition.clear_boundaries"),
    ({"has_procedure": True}, "problem_decomposition.has_hierarchy problem_decomposition.clear_boundaries problem_decomposition.dependencies_explicit procedures.custom_blocks_used"),
    ({"comment_part": True, "comment_debug": True, "comment_fix": True}, "problem_decomposition.comments_describe_subproblems debugging.debugging_comments_present debugging.fixes_documented"),
    ({"has_broadcast": True}, "problem_decomposition.has_hierarchy problem_decomposition.dependencies_explicit sequencing.unnecessary_steps_avoided messaging.broadcasts_used"),
    ({"named_target": True, "named_list": True}, "problem_decomposition.subproblems_named_or_documented lists.list_based_systems_designed"),
    ({"block_count": 10}, "sequencing.logical_order algorithms.step_by_step_strategy"),
    ({"has_loop": True, "nested_control_count": 1}, "sequencing.unnecessary_steps_avoided loops.loops_used_instead_of_duplication loops.loops_nested"),
    ({"has_conditional": True, "conditional_count": 1, "has_compound": True}, "sequencing.unnecessary_steps_avoided conditionals.boolean_conditions_correct"),
    (
        {"has_conditional": True, "conditional_count": 2, "if_else_count": 1, "has_compound": True},
        "sequencing.unnecessary_steps_avoided conditionals.boolean_conditions_correct conditionals.if_else_used conditionals.multi_branch_states_handled "
        "conditionals.compound_conditions_used conditionals.conditional_logic_clean algorithms.edge_cases_handled",
    ),
    ({"has_variable": True, "variable_name_count": 1}, "variables.variables_used variables.variables_initialized"),
    (
        {"has_variable": True, "variable_name_count": 2, "named_variable": True, "has_event": True},
        "sequencing.clear_start_to_finish_flow variables.variables_used variables.variables_initialized variables.variable_names_descriptive variables.multiple_states_tracked "
        "variables.variables_updated_on_events variables.coherent_variable_system",
    ),
    ({"has_other_event": True, "event_type_count": 1, "handler_count": 1}, "event_handling.events_beyond_green_flag"),
    (
        {"event_type_count": 2, "handler_count": 2, "descriptive_broadcast_count": 1},
        "event_handling.multiple_event_types_handled event_handling.handlers_attached_to_correct_sprites event_handling.event_names_descriptive event_handling.sprites_react_independently",
    ),
    (
        {"broadcast_send_count": 1, "broadcast_receive_count": 2, "event_type_count": 6},
        "event_handling.multiple_event_types_handled event_handling.event_conflicts_avoided messaging.sprites_respond_correctly",
    ),
    ({"broadcast_send_count": 1, "broadcast_receive_count": 3, "event_type_count": 6}, "event_handling.multiple_event_types_handled messaging.sprites_respond_correctly"),
    ({"broadcast_send_count": 2, "broadcast_receive_count": 1, "event_type_count": 7}, "event_handling.multiple_event_types_handled"),
    (
        {"sprite_count": 2, "handler_count": 2, "broadcast_send_count": 2, "broadcast_receive_count": 4, "descriptive_broadcast_count": 2},
        "problem_decomposition.has_subproblems problem_decomposition.clear_boundaries event_handling.handlers_attached_to_correct_sprites event_handling.event_names_descriptive "
        "event_handling.sprites_react_independently messaging.messages_differently_named messaging.sprites_respond_correctly messaging.multi_sprite_interactions_coordinated "
        "messaging.messaging_architecture_clear messaging.circular_dependencies_avoided",
    ),
    (
        {"procedure_definition_count": 1, "procedure_call_count": 2},
        "procedures.custom_blocks_have_parameters procedures.custom_blocks_reused procedures.custom_blocks_reduce_duplication procedures.block_names_descriptive procedures.complex_behaviors_abstracted",
    ),
    (
        {"has_loop": True, "has_conditional": True, "loop_count": 1, "operator_count": 1},
        "sequencing.unnecessary_steps_avoided loops.loops_used_instead_of_duplication algorithms.algorithm_works_for_inputs algorithms.efficiency_considered",
    ),
    (
        {"has_loop": True, "max_control_nesting_depth": 2},
        "sequencing.unnecessary_steps_avoided loops.loops_used_instead_of_duplication nesting.loops_nested nesting.nesting_correct",
    ),
    (
        {"has_loop": True, "has_conditional": True, "max_control_nesting_depth": 4, "nested_control_count": 10},
        "sequencing.unnecessary_steps_avoided loops.loops_used_instead_of_duplication loops.loops_nested algorithms.algorithm_works_for_inputs nesting.loops_nested nesting.conditionals_nested "
        "nesting.nesting_correct nesting.nesting_serves_clear_purpose nesting.nested_systems_used",
    ),
    (
        {"has_list": True, "has_list_access": True, "has_list_update": True, "has_loop": True},
        "sequencing.unnecessary_steps_avoided loops.loops_used_instead_of_duplication lists.lists_used lists.list_items_accessed_dynamically lists.list_operations_used "
        "lists.lists_processed_with_loops lists.lists_updated_during_gameplay",
    ),
    ({"has_operator": True}, "math.arithmetic_operators_used math.dynamic_values_computed"),
    (
        {"state_variable": True, "screen_target": True, "has_message": True, "has_event": True},
        "sequencing.clear_start_to_finish_flow ui_feedback.score_lives_timer_shown ui_feedback.ui_updates_in_real_time ui_feedback.ui_clear_and_readable "
        "ui_feedback.start_end_screens_present ui_feedback.feedback_messages_used",
    ),
]
#: Dimensions whose rules the cases show whole; the others have a case in tests/test_features.py.
SHOWN = ["problem_decomposition", "sequencing", "loops", "conditionals", "variables", "event_handling", "debugging", "procedures", "ui_feedback", "lists", "math", "messaging", "algorithms", "nesting", "integration"]


def test_questions_by_hand(spark):
    rows = [(i, *(int(case.get(c, 0)) for c in COUNTS), *(bool(case.get(c, False)) for c in FLAGS)) for i, (case, _) in enumerate(CASES)]
    schema = "project_id int, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} boolean" for c in FLAGS)
    long = fe.atomic_answers_long(spark.createDataFrame(rows, schema)).filter("answer").collect()
    for i, (case, yes) in enumerate(CASES):
        got = {f"{r.dimension}.{r.question}" for r in long if r.project_id == i and r.dimension in SHOWN}
        assert got == set(yes.split()), case


def test_the_cases_show_every_answerable_question():
    shown = {q for _, yes in CASES for q in yes.split()}
    assert {f"{d}.{q}" for d in SHOWN for q, rule in QUESTIONS[d].items() if rule != "false"} == shown
    assert set(QUESTIONS) == set(dims.DIMENSIONS) and set(LADDERS) <= set(QUESTIONS)


@pytest.mark.parametrize(
    ("condition", "features", "holds"),
    [
        ("uses_algorithms and block_count >= 30", (True, 30, 1), True), ("uses_algorithms and block_count >= 30", (True, 29, 1), False),
        ("uses_algorithms and block_count >= 30", (False, 30, 1), False), ("sprite_count >= 5", (False, 0, 5), True), ("sprite_count >= 5", (False, 0, 4), False),
        ("block_count >= 50", (False, 50, 0), True), ("block_count >= 50", (False, 49, 0), False),
    ],
)
def test_conditions_of_hints_and_steps(spark, condition, features, holds):
    df = spark.createDataFrame([features], "uses_algorithms boolean, block_count long, sprite_count long").select(F.struct("*").alias("f"))
    assert df.select(prompt._condition(F.col("f"), condition).alias("x")).first().x is holds


def digest(value) -> str:
    return hashlib.sha256(repr(value).encode()).hexdigest()[:16]


def test_fixed_texts_are_as_they_were():
    texts = {
        "hints": prompt.HINTS, "steps": prompt.STEPS, "evidence": prompt.EVIDENCE_RULES, "final": prompt.FINAL_ONLY, "balance": prompt.BALANCE, "openings": prompt.OPENINGS,
        "short": prompt.SHORT_SNIPPETS, "long": prompt.LONG_SNIPPETS, "expert": prompt.EXPERT, "levels": guides.LEVELS, "asked": guides.ASKED, "summaries": dims.SUMMARIES,
        "categories": dims.CATEGORIES, "dimensions": dims.DIMENSIONS, "sheet": dims.SHEET_COLUMNS, "notes": prompt.VARIABLES_NOTE,
    }
    assert {k: digest(v) for k, v in texts.items()} == DIGESTS


DIGESTS = {
    "hints": "2296c12aefdddb82",
    "steps": "6526f6287a068de1",
    "evidence": "3463ba25a7a9acbe",
    "final": "15a77e9003f119ef",
    "balance": "301310726dc22773",
    "openings": "69d450f18c97828c",
    "short": "d58299680dd7c700",
    "long": "f1c588999231e431",
    "expert": "70ed0c0124d03443",
    "levels": "3af8a2b956848b90",
    "asked": "439e6094c6babbab",
    "summaries": "0b3e91ab02ff0f30",
    "categories": "ab37768244a04629",
    "dimensions": "11d605ea6121f11a",
    "sheet": "b19b61bdbcd6f7dd",
    "notes": "259a6ac5d46aa815",
}
