"""The rubric's rules: which evidence answers a question with yes, and which answers make a score.

The names of dimensions and questions are given; what stands beside them is logic over the columns of features.project_context(), in
SQL that Spark and the oracles both read. There is this one table of it: that it says what the rubric means is shown by hand-made cases in
tests/test_rubric.py, not by a second wording.
"""

from __future__ import annotations

#: dimension -> question -> when it is answered with yes. Block programs give no evidence for those that are "false".
QUESTIONS: dict[str, dict[str, str]] = {
    "problem_decomposition": {
        "has_subproblems": "sprite_count > 1",
        "has_hierarchy": "has_procedure or has_broadcast",
        "comments_describe_subproblems": "comment_part",
        "clear_boundaries": "sprite_count > 1 or has_procedure",
        "dependencies_explicit": "has_broadcast or has_procedure",
        "subproblems_named_or_documented": "named_target",
    },
    "sequencing": {
        "logical_order": "block_count > 0",
        "misordered_block_breaks_behavior": "false",
        "clear_start_to_finish_flow": "has_event",
        "unnecessary_steps_avoided": "has_loop or has_conditional or has_broadcast",
        "optimized_order": "false",
    },
    "loops": {
        "loops_used_instead_of_duplication": "has_loop",
        "repeat_counts_correct": "false",
        "termination_conditions_correct": "false",
        "loops_nested": "nested_control_count > 0",
        "loop_types_appropriate": "false",
        "edge_cases_handled": "false",
    },
    "conditionals": {
        "if_else_used": "if_else_count > 0",
        "boolean_conditions_correct": "conditional_count > 0",
        "compound_conditions_used": "has_compound and conditional_count >= 2",
        "redundant_checks_avoided": "false",
        "multi_branch_states_handled": "if_else_count > 0",
        "conditional_logic_clean": "conditional_count >= 2",
    },
    "variables": {
        "variables_used": "has_variable",
        "variables_initialized": "variable_name_count > 0",
        "variable_names_descriptive": "named_variable",
        "multiple_states_tracked": "variable_name_count > 1",
        "variables_updated_on_events": "has_event and has_variable",
        "coherent_variable_system": "variable_name_count > 0 and named_variable",
    },
    "event_handling": {
        "events_beyond_green_flag": "has_other_event",
        "multiple_event_types_handled": "event_type_count >= 2",
        "handlers_attached_to_correct_sprites": "handler_count >= 2",
        "event_names_descriptive": "descriptive_broadcast_count >= 1",
        "sprites_react_independently": "handler_count >= 2",
        "event_conflicts_avoided": "broadcast_send_count >= 1 and broadcast_receive_count between greatest(1, broadcast_send_count) and broadcast_send_count * 2 and event_type_count between 2 and 6",
    },
    "debugging": {
        "debugging_comments_present": "comment_debug",
        "variable_values_displayed_for_debugging": "false",
        "code_isolated_for_testing": "false",
        "edge_cases_tested": "false",
        "subtle_logic_bugs_addressed": "false",
        "fixes_documented": "comment_fix",
    },
    "procedures": {
        "custom_blocks_used": "has_procedure",
        "custom_blocks_have_parameters": "procedure_definition_count > 0",
        "custom_blocks_reused": "procedure_call_count >= 2",
        "custom_blocks_reduce_duplication": "procedure_call_count >= 2",
        "block_names_descriptive": "procedure_definition_count > 0",
        "complex_behaviors_abstracted": "procedure_definition_count > 0 and procedure_call_count > 0",
    },
    "coordinates": {
        "x_y_blocks_used": "has_absolute_move",
        "positions_updated_dynamically": "has_coordinate",
        "incremental_movements_used": "has_relative_move",
        "boundaries_checked": "has_edge_bounce",
        "positions_calculated_mathematically": "has_operator and has_coordinate",
        "coordinate_systems_designed": "false",
    },
    "cloning": {
        "clones_created": "has_clone",
        "clones_behave_differently_from_originals": "false",
        "clones_deleted_when_no_longer_needed": "false",
        "clone_specific_variables_initialized": "false",
        "clone_quantity_controlled": "false",
        "complex_clone_systems_used": "false",
    },
    "collision": {
        "touching_blocks_used": "has_collision",
        "collision_checked_inside_loops": "has_collision and has_loop",
        "multiple_collision_types_handled": "false",
        "collisions_reliable_every_frame": "false",
        "collision_outcomes_distinct": "false",
        "timing_size_issues_handled": "false",
    },
    "animation": {
        "costume_changes_used": "costume_switch_count > 0",
        "animation_timing_correct": "costume_switch_count > 0 and wait_count > 0",
        "animations_loop_smoothly": "costume_switch_count >= 2 and loop_count > 0",
        "animations_tied_to_game_events": "costume_switch_count > 0 and has_event",
        "multiple_animation_states_used": "costume_switch_count >= 3",
        "transitions_smooth": "costume_switch_count >= 3 and wait_count > 0",
    },
    "sound": {
        "sounds_used": "has_sound",
        "sounds_triggered_by_events": "has_sound and has_event",
        "timing_correct_no_overlap": "false",
        "background_music_separated_from_sfx": "false",
        "start_sound_vs_play_until_done_correct": "false",
        "layered_sound_system": "false",
    },
    "ui_feedback": {
        "score_lives_timer_shown": "state_variable",
        "ui_updates_in_real_time": "state_variable and has_event",
        "ui_clear_and_readable": "has_ui_feedback or state_variable",
        "start_end_screens_present": "screen_target",
        "feedback_messages_used": "has_message",
        "ui_polished_and_consistent": "false",
    },
    "lists": {
        "lists_used": "has_list",
        "list_items_accessed_dynamically": "has_list_access",
        "list_operations_used": "has_list",
        "lists_processed_with_loops": "has_list and has_loop",
        "lists_updated_during_gameplay": "has_list_update",
        "list_based_systems_designed": "named_list",
    },
    "math": {
        "arithmetic_operators_used": "has_operator",
        "dynamic_values_computed": "has_operator",
        "advanced_operators_used": "false",
        "operators_chosen_correctly": "false",
        "mathematical_models_used": "false",
        "random_or_formula_used": "false",
    },
    "messaging": {
        "broadcasts_used": "has_broadcast",
        "messages_differently_named": "descriptive_broadcast_count >= 2",
        "sprites_respond_correctly": "broadcast_send_count > 0 and broadcast_receive_count >= broadcast_send_count",
        "multi_sprite_interactions_coordinated": "sprite_count > 1 and handler_count >= 2 and broadcast_send_count >= 2 and broadcast_receive_count >= 2",
        "messaging_architecture_clear": "descriptive_broadcast_count >= 2 and broadcast_send_count >= 2 and broadcast_receive_count >= 2",
        "circular_dependencies_avoided": "broadcast_send_count >= 2 and broadcast_receive_count between 2 and broadcast_send_count * 2",
    },
    "algorithms": {
        "step_by_step_strategy": "block_count >= 10",
        "algorithm_works_for_inputs": "has_loop and has_conditional",
        "edge_cases_handled": "if_else_count > 0",
        "efficiency_considered": "loop_count > 0 and operator_count > 0",
        "alternative_approaches_evaluated": "false",
        "algorithms_documented": "false",
    },
    "nesting": {
        "loops_nested": "max_control_nesting_depth >= 2 and has_loop",
        "conditionals_nested": "max_control_nesting_depth >= 2 and has_conditional",
        "nesting_correct": "max_control_nesting_depth >= 2",
        "nesting_serves_clear_purpose": "max_control_nesting_depth >= 3 and nested_control_count >= 5 and has_loop and has_conditional",
        "nested_structures_documented": "false",
        "nested_systems_used": "max_control_nesting_depth >= 4 and nested_control_count >= 10",
    },
    "integration": {
        "major_systems_work_together": "false",
        "project_fully_playable": "false",
        "features_consistent_across_sprites": "false",
        "skills_integrated_smoothly": "false",
        "project_polished": "false",
        "whole_system_demonstrates_mastery": "false",
    },
}

#: dimension -> (condition, score) in order; the first that holds decides. A question's name is its answer here, n the number of yeses. Dimensions
#: that aren't here are scored by the share of yeses.
LADDERS: dict[str, list[tuple[str, int]]] = {
    "debugging": [("n = 0", 0), ("n = 1", 1), ("true", 2)],
    "integration": [("n = 0", 0), ("n = 1", 1), ("true", 2)],
    "conditionals": [
        ("not boolean_conditions_correct", 1),
        ("not if_else_used", 2),
        ("compound_conditions_used and conditional_logic_clean", 4),
        ("true", 3),
    ],
    "variables": [
        ("not variables_used", 1),
        ("not variables_initialized", 2),
        ("multiple_states_tracked and variables_updated_on_events and coherent_variable_system", 4),
        ("multiple_states_tracked and variables_updated_on_events", 3),
        ("variable_names_descriptive", 3),
        ("true", 2),
    ],
    "event_handling": [
        ("not (events_beyond_green_flag and handlers_attached_to_correct_sprites)", 1),
        ("not (multiple_event_types_handled and sprites_react_independently)", 2),
        ("not (event_names_descriptive and event_conflicts_avoided)", 3),
        ("true", 5),  # all six hold here
    ],
    "messaging": [
        ("not broadcasts_used", 1),
        ("not sprites_respond_correctly", 2),
        ("messaging_architecture_clear and multi_sprite_interactions_coordinated and n = 6", 5),
        ("messaging_architecture_clear and multi_sprite_interactions_coordinated", 4),
        ("messages_differently_named", 3),
        ("true", 2),
    ],
    "ui_feedback": [
        ("n = 0", 1),
        ("start_end_screens_present and score_lives_timer_shown", 4),
        ("n >= 3", 3),
        ("true", 2),
    ],
    "coordinates": [
        ("not positions_updated_dynamically", 1),
        ("positions_calculated_mathematically or boundaries_checked", 4),
        ("true", 3),
    ],
    "problem_decomposition": [
        ("not has_subproblems", 1),
        ("has_hierarchy and dependencies_explicit", 4),
        ("clear_boundaries", 3),
        ("true", 2),
    ],
    "nesting": [
        ("not loops_nested and not conditionals_nested", 1),
        ("not (nesting_correct and nesting_serves_clear_purpose)", 2),
        ("nested_systems_used", 4),
        ("loops_nested and conditionals_nested", 3),
        ("true", 2),
    ],
    "procedures": [
        ("not custom_blocks_used", 1),
        ("custom_blocks_reused and complex_behaviors_abstracted", 4),
        ("custom_blocks_have_parameters", 3),
        ("true", 2),
    ],
    "animation": [
        ("not costume_changes_used", 1),
        ("multiple_animation_states_used and transitions_smooth", 4),
        ("animation_timing_correct or animations_loop_smoothly", 3),
        ("true", 2),
    ],
    "algorithms": [
        ("not step_by_step_strategy", 1),
        ("not algorithm_works_for_inputs", 2),
        ("efficiency_considered and edge_cases_handled", 4),
        ("true", 3),
    ],
    "lists": [
        ("not lists_used", 1),
        ("not list_operations_used", 2),
        ("lists_processed_with_loops and lists_updated_during_gameplay and list_items_accessed_dynamically and list_based_systems_designed", 5),
        ("lists_processed_with_loops and lists_updated_during_gameplay", 4),
        ("list_items_accessed_dynamically or lists_updated_during_gameplay", 3),
        ("true", 2),
    ],
}
