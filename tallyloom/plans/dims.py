"""The rubric: dimensions, their sheet columns, categories, questions and level summaries."""

from __future__ import annotations

# Results and prompts depend on these words and their order.
SHEET_COLUMNS = {
    "1.Decomp": "problem_decomposition",
    "2.Sequencing": "sequencing",
    "3.Loops": "loops",
    "4.Conditionals": "conditionals",
    "5.Variables": "variables",
    "6.Event Handling": "event_handling",
    "7.Debugging": "debugging",
    "8.Procedures": "procedures",
    "9.Coordinates": "coordinates",
    "10.Cloning": "cloning",
    "11.Collision": "collision",
    "12.Animation": "animation",
    "13.Sound": "sound",
    "14.UI": "ui_feedback",
    "15.Lists": "lists",
    "16.Math": "math",
    "17.Messaging": "messaging",
    "18.Algorithms": "algorithms",
    "19.Nesting": "nesting",
    "20.Integration": "integration",
}
DIMENSIONS = list(SHEET_COLUMNS.values())

# The categories, in their order, and the names of features.
CATEGORIES = {
    "core_logic": ["problem_decomposition", "sequencing", "loops", "conditionals", "algorithms", "nesting"],
    "state_data": ["variables", "lists", "math"],
    "interactivity_events": ["event_handling", "messaging", "ui_feedback"],
    "media_physics": ["coordinates", "cloning", "collision", "animation", "sound"],
    "engineering_quality": ["debugging", "procedures", "integration"],
}

NUMERIC_FEATURES = ["sprite_count", "block_count", "variable_count", "list_count"]
FLAG_FEATURES = [
    "uses_loops",
    "uses_conditionals",
    "uses_variables",
    "uses_event_handling",
    "uses_cloning",
    "uses_collision",
    "uses_animation",
    "uses_sound",
    "uses_ui_feedback",
    "uses_lists",
    "uses_math",
    "uses_messaging",
    "uses_algorithms",
    "uses_nesting",
    "uses_integration",
]
FEATURES = NUMERIC_FEATURES + FLAG_FEATURES

# Level summaries, as prompts show them.
SUMMARIES = {
    "problem_decomposition": "1=no decomposition | 2=partial/incomplete | 3=clear manageable parts | 4=systematic with dependencies | 5=hierarchical top-down",
    "sequencing": "1=random/incorrect | 2=mostly correct with one misorder | 3=correct logical flow | 4=efficient deliberate | 5=optimal adaptable",
    "loops": "1=duplicates code | 2=simple repeat misused | 3=correct repeat-until | 4=appropriate type combined | 5=optimized nested with edge cases",
    "conditionals": "1=no conditionals | 2=basic if only | 3=correct if/else | 4=multiple AND/OR | 5=elegant multi-branch",
    "variables": "1=none | 2=declared misused | 3=correct storage updates | 4=multiple descriptive with reset | 5=coherent multi-state",
    "event_handling": "1=green flag only | 2=one or two events missed | 3=correct multi-event | 4=independent event architecture | 5=coordinated no conflicts",
    "debugging": "1=random changes | 2=finds obvious bugs | 3=systematic isolation | 4=subtle logic errors | 5=methodical testing documented",
    "procedures": "1=no custom blocks | 2=blocks lack parameters | 3=parameterized reusable | 4=library reducing duplication | 5=elegant abstraction",
    "coordinates": "1=drag-drop only | 2=fixed hardcoded | 3=absolute incremental | 4=math-based boundaries | 5=grids advanced trajectories",
    "cloning": "1=manual duplication | 2=clones lack behavior | 3=creates deletes correctly | 4=manages lifecycles | 5=complex systems waves",
    "collision": "1=no detection | 2=out-of-loop checks | 3=reliable sprite/edge | 4=sprite edge color | 5=size timing outcomes",
    "animation": "1=static sprites | 2=poor timing | 3=smooth costume loops | 4=linked to events | 5=state-driven idle/walk/jump",
    "sound": "1=no audio | 2=bad timing overlapping | 3=event-triggered contextual | 4=manages music vs effects | 5=layered balanced",
    "ui_feedback": "1=missing score/lives | 2=cluttered overlapping | 3=real-time main stats | 4=start end screens | 5=polished combined states",
    "lists": "1=uses single variables | 2=hardcoded indices | 3=add delete item-of | 4=dynamic search/modify loops | 5=inventory high-score formats",
    "math": "1=hardcoded only | 2=simple errors | 3=dynamic speed offsets scores | 4=fluent mod rounding mult div | 5=physics scaling models",
    "messaging": "1=one sprite all control | 2=single generic message | 3=named broadcasts | 4=descriptive architecture | 5=protocol no race",
    "algorithms": "1=ad-hoc coincidence | 2=fails edge cases | 3=step-by-step all inputs | 4=efficient reasoned | 5=optimized documented",
    "nesting": "1=flat no nesting | 2=incorrect scope | 3=functional nested | 4=deliberate structured | 5=state machines complex",
    "integration": "1=isolated non-functional | 2=features broken disconnected | 3=fully playable baseline | 4=polished seamless | 5=flawless mastery",
}
