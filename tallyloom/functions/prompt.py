"""Prompt texts as column expressions.

features is a struct, grades a map or struct shown in its own order; examples is an array of struct(features, grades), nearest first.
Values that carry meaning for a model stand here as fixed text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.dims import CATEGORIES, DIMENSIONS, FEATURES, FLAG_FEATURES, SUMMARIES
from tallyloom.plans.guides import ASKED, LEVELS

# The wording of prompts.
EVIDENCE_RULES = """EVIDENCE-FIRST GRADING PROCESS (must follow):
1) Infer evidence from features first.
2) Then assign scores 0-5 from evidence.
3) Be conservative when evidence is missing.

Weak dimensions to evaluate carefully:
- problem_decomposition
- sequencing
- animation
- algorithms
- nesting

High-score gates:
- algorithms=5 only if ALL are evidenced: step-by-step strategy, works across inputs, edge-case handling, efficiency awareness.
- animation=5 only if ALL are evidenced: costume/sprite changes, smooth looping, event-linked transitions.
- sequencing>=4 only if logical order and clear start-to-finish flow are evidenced.
- problem_decomposition>=4 only if clear subproblems plus hierarchy/dependencies are evidenced.
- nesting>=4 only if nesting is purposeful and not incidental."""
FINAL_ONLY = """Return ONLY valid JSON.
No markdown. No prose. No explanation.
Include all 20 rubric keys with integer values 0-5 only."""
ONLY_GRADES = "Return only the grades as a JSON object with the same rubric keys."
BALANCE = "Use balanced scoring: low only when evidence is absent, mid when partial, high when multiple signals agree."
#: (dimension, what it hangs on, text if so, text if not); {x} is a feature's value.
HINTS = [
    ("variables", "variable_count > 0", "{variable_count} variable(s) defined. {variables_note}Score reflects proper initialization, updates on events, and reset logic.", "{variable_count} variable(s) defined. No variables → level 1."),
    ("math", "uses_math", "Math operators detected. Score based on complexity (simple arithmetic→3, division/modulo→4, physics models→5).", "No math operators → level 1 (hardcoded only)."),
    ("lists", "list_count > 0", "{list_count} list(s) present. Score based on: hardcoded indices→2, add/delete operations→3, dynamic loops→4, inventory systems→5.", "No lists defined → level 1 (single variables)."),
    ("sound", "uses_sound", "Sound blocks detected. Score based on timing, context (event-triggered→3), music vs effects separation→4, layering→5.", "No audio blocks → level 1."),
    ("collision", "uses_collision", "Collision blocks detected. Score based on: out-of-loop→2, reliable in loops→3, sprite/edge/color checks→4, size/timing accounting→5.", "No collision detection → level 1."),
    ("event_handling", "uses_event_handling", "Event blocks detected. Score should reflect whether the project goes beyond green flag, coordinates multiple triggers, and assigns events across sprites rather than centralising all control.", "No event blocks beyond basic startup evidence → low score unless other trigger evidence exists."),
    ("messaging", "uses_messaging", "Broadcast blocks detected. Score based on whether messages seem distinct, support sprite coordination, and avoid a single generic broadcast for all state changes.", "No broadcast blocks → level 1."),
    ("procedures", "uses_algorithms and block_count >= 30", "Larger projects should only score highly here if custom reusable blocks are truly present and reduce duplication; project size alone should not inflate the score.", "Only score above the baseline when there is clear evidence of custom reusable abstractions."),
    ("nesting", "uses_nesting", "Loops and conditionals both appear. Only assign high scores if control structures are meaningfully nested rather than merely coexisting in separate scripts.", "No evidence of nested control structures → low score."),
    ("ui_feedback", "uses_ui_feedback", "Say/think/visual feedback exists. Score should distinguish simple feedback from a maintained score/lives/timer UI and proper start/end states.", "No visible UI feedback blocks → low score unless other explicit UI evidence is present."),
]
VARIABLES_NOTE = ("Variables are present and likely used for state tracking. ", "Variables declared but usage unclear. ")
#: The same for step-by-step reasoning over an example, whose grade stands in brackets.
STEPS = [
    ("problem_decomposition", "sprite_count >= 5", "{sprite_count} sprite(s) and {block_count} block(s) suggest strong decomposition across multiple actors.", "{sprite_count} sprite(s) and {block_count} block(s) suggest limited decomposition."),
    ("sequencing", "block_count >= 50", "{block_count} block(s) indicate a well-ordered sequence of instructions.", "{block_count} block(s) indicate a short or simple sequence."),
    ("loops", "uses_loops", "Loop blocks detected — repetition is present.", "No loop blocks found."),
    ("conditionals", "uses_conditionals", "Conditional blocks detected — branching logic is present.", "No conditional blocks found."),
    ("variables", "uses_variables", "{variable_count} variable(s) defined. Variables are actively used.", "{variable_count} variable(s) defined. No variable usage detected."),
    ("event_handling", "uses_event_handling", "Event blocks detected — project responds to triggers.", "No event blocks detected."),
    ("debugging", "true", "Debugging evidence is not directly detectable from block counts alone.", ""),
    ("procedures", "uses_algorithms and block_count >= 30", "Custom procedure blocks detected — code is modularised.", "No custom procedure blocks detected."),
    ("coordinates", "uses_event_handling and sprite_count >= 2", "Coordinate-based motion blocks detected.", "No explicit coordinate usage detected."),
    ("cloning", "uses_cloning", "Clone blocks detected — dynamic sprite creation is used.", "No cloning detected."),
    ("collision", "uses_collision", "Collision/touching sensing blocks detected.", "No collision detection found."),
    ("animation", "uses_animation", "Costume-switching blocks detected — animation is present.", "No animation blocks detected."),
    ("sound", "uses_sound", "Sound blocks detected — audio is used.", "No sound blocks detected."),
    ("ui_feedback", "uses_ui_feedback", "UI feedback blocks (say/think/visuals) detected.", "No UI feedback blocks detected."),
    ("lists", "uses_lists", "{list_count} list(s) defined. Lists are used for data storage.", "{list_count} list(s) defined. No list usage detected."),
    ("math", "uses_math", "Math/operator blocks detected.", "No math operator blocks detected."),
    ("messaging", "uses_messaging", "Broadcast/message blocks detected — inter-sprite communication is used.", "No broadcast blocks detected."),
    ("algorithms", "uses_loops and uses_conditionals", "{block_count} block(s) with loops and conditionals suggest algorithmic thinking.", "Limited algorithmic structure detected."),
    ("nesting", "uses_nesting", "Loops and conditionals both present — nesting is likely.", "No evidence of nested control structures."),
    ("integration", "uses_integration", "Multiple concepts combined across sprites — integration is evident.", "Limited cross-concept integration detected."),
]


def _value(features: Column, name: str) -> Column:
    v = features[name]
    return F.when(v, "True").otherwise("False") if name in FLAG_FEATURES else v.cast("string")


def feature_lines(features: Column) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"  {c}: "), _value(features, c)) for c in FEATURES))


def grade_lines(grades: Column, dimensions: list[str] = DIMENSIONS) -> Column:
    """grades: array<int> in the order of DIMENSIONS; null ones are left out."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"  {d}: "), F.get(grades, F.lit(DIMENSIONS.index(d))).cast("string")) for d in dimensions))


def _condition(features: Column, text: str) -> Column:
    out = F.lit(True)
    for part in text.split(" and "):
        words = part.split()
        if words[0] == "true":
            continue
        v = features[words[0]]
        one = F.coalesce(v, F.lit(False)) if len(words) == 1 else F.coalesce(v > int(words[2]) if words[1] == ">" else v >= int(words[2]), F.lit(False))
        out = out & one
    return out


def _filled(features: Column, text: str) -> Column:
    parts = []
    for i, piece in enumerate(text.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece == "variables_note":
            parts.append(F.when(features["uses_variables"], VARIABLES_NOTE[0]).otherwise(VARIABLES_NOTE[1]))
        else:
            parts.append(features[piece].cast("string"))
    return F.concat(*parts)


def hints(features: Column, only: list[str] | None = None) -> Column:
    """Hints on ten dimensions from features alone; with only, those lines that hold one of these words anywhere."""
    lines = [
        F.concat(F.lit(f"  - {d}: "), F.when(_condition(features, c), _filled(features, yes)).otherwise(_filled(features, no))) for d, c, yes, no in HINTS
    ]
    if only is not None:
        lines = [F.when(_any(x, only), x) for x in lines]
    return F.concat_ws("\n", *lines)


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def reasoning(features: Column, grades: Column) -> Column:
    first = _filled(features, "  - The project has {sprite_count} sprite(s) and {block_count} block(s), giving a rough sense of overall complexity.")
    grade = lambda d: F.coalesce(F.get(grades, F.lit(DIMENSIONS.index(d))).cast("string"), F.lit("?"))
    return F.concat_ws(
        "\n",
        first,
        *(
            F.concat(F.lit(f"  - {d} ("), grade(d), F.lit("): "), F.when(_condition(features, c), _filled(features, yes)).otherwise(_filled(features, no)))
            for d, c, yes, no in STEPS
        ),
    )


def _examples(examples: Column, dimensions: list[str] = DIMENSIONS, think: bool = False) -> Column:
    """Blocks of the examples, a blank line between them."""

    def block(x: Column, i: Column) -> Column:
        lines = [F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":")), F.lit("Features:"), feature_lines(x["features"])]
        if think:
            lines += [F.lit("Reasoning:"), reasoning(x["features"], x["grades"])]
        return F.concat_ws("\n", *lines, F.lit("Grades:"), grade_lines(x["grades"], dimensions))

    return F.array_join(F.transform(examples, block), "\n\n")


def _blocks(*parts: Column | str) -> Column:
    return F.concat_ws("\n\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _target(features: Column, head: str, *more: Column | str) -> Column:
    return F.concat_ws("\n", F.lit(head), F.lit("Features:"), feature_lines(features), *(F.lit(m) if isinstance(m, str) else m for m in more))


def few_shot(features: Column, examples: Column) -> Column:
    return _blocks(_examples(examples), _target(features, "Now grade this new project:"), ONLY_GRADES)


def chain_of_thought(features: Column, examples: Column) -> Column:
    think = "\nThink step-by-step about how the features relate to each rubric dimension.\nThen output ONLY the final grades as a strictly valid JSON object with the same rubric keys."
    return _blocks(_examples(examples, think=True), _target(features, "Now grade this new project:", think))


def hybrid(features: Column, examples: Column) -> Column:
    summary = "RUBRIC SUMMARY (Levels 1–5):\n\n" + "\n".join(f"• {d}: {s}" for d, s in SUMMARIES.items())
    keys = f"Required JSON keys (exact, all must be present): {json.dumps(list(SUMMARIES))}"
    target = _target(features, "Now grade this new project:", "Reasoning (for feature-driven dimensions):", hints(features), BALANCE)
    return _blocks(summary, EVIDENCE_RULES, keys, _examples(examples), target, FINAL_ONLY)


def category(features: Column, examples: Column, name: str, style: str = "hybrid") -> Column:
    """Only the dimensions of one category; hints only in the hybrid style, and only lines that mention one of them."""
    if name not in CATEGORIES:
        raise ValueError(f"unknown category: {name}")
    dims = CATEGORIES[name]
    head = f"CATEGORY: {name.upper()}\nFocus ONLY on these dimensions: {', '.join(dims)}\n"
    summary = "RUBRIC SUMMARY:\n" + "\n".join(f"• {d}: {SUMMARIES[d]}" for d in dims)
    some = hints(features, dims)
    extra = F.when(F.lit(style == "hybrid") & (some != ""), F.concat(F.lit("\nReasoning (for feature-driven dimensions in this category):\n"), some)).otherwise("")
    target = F.concat(_target(features, "Now grade this new project:"), extra)
    last = f"Return ONLY a JSON object with integer scores (0–5) for these exact keys: {json.dumps(dims)}. Do NOT include reasoning in the JSON."
    return _blocks(head, summary, _examples(examples, [d for d in DIMENSIONS if d in dims]), target, last)


def guided(features: Column, examples: Column, levels: dict[str, str] = LEVELS) -> Column:
    """With the full rubric; levels gives each dimension's descriptions, in the order of the codes."""
    lines = ["SCORING GUIDE - Rubric Dimensions (1=Novice to 5=Expert):\n"]
    for i, (d, what) in enumerate(levels.items(), 1):
        lines += [f"TRUNK-{i:02d}: {d.upper()}", f"{what}\n"]
    last = ONLY_GRADES.removesuffix(".") + ", referring to the scoring guide for each dimension."
    return _blocks("\n".join(lines), _examples(examples), _target(features, "Now grade this new project using the rubric guide above:"), last)


def questioned(features: Column, examples: Column, asked: dict[str, list[str]] = ASKED) -> Column:
    """With questions in place of the rubric; asked gives each dimension's, in order."""
    lines = ["QUESTION GUIDE (Levels 1-5):\n"]
    for i, (d, questions) in enumerate(asked.items(), 1):
        lines += [f"{i}. {d.replace('_', ' ').title()}", *(f"- {q}" for q in questions), ""]
    lines.append("Score mapping: 1 = no skill, 2 = partial skill, 3 = correct skill, 4 = efficient skill, 5 = expert skill.")
    last = ONLY_GRADES.removesuffix(".") + ", using the question guide and the score mapping above."
    return _blocks("\n".join(lines), _examples(examples), _target(features, "Now grade this new project using the question guide above:"), last)


STYLES = {"few_shot": few_shot, "chain_of_thought": chain_of_thought, "rubric_reference": guided, "question_based": questioned, "hybrid": hybrid}

# The wording of generic prompts and of their variants.
EXPERT = "You are an expert in grading student projects. Carefully evaluate the features and provide grades."
OPENINGS = [
    "You are a careful rubric grader. Use the examples to infer scores.",
    "Act as an objective grader. Rely on the examples and the facts above.",
    "Follow the rubric; prefer conservative judgments when uncertain.",
]
LONG_SNIPPETS = {
    "algorithms": "Selective reasoning (algorithms): If relevant, briefly identify core algorithmic patterns (e.g., loops, conditionals, event flow) in one line.",
    "sequencing": "Selective reasoning (sequencing): If relevant, list key ordered steps the project executes (1-3 bullets).",
    "integration": "Selective reasoning (integration): If relevant, note how sprites/variables communicate or reuse code.",
}
SHORT_SNIPPETS = {
    "algorithms": "Selective reasoning (algorithms): briefly identify core algorithmic patterns (loops, conditionals, event flow).",
    "sequencing": "Selective reasoning (sequencing): list key ordered steps the project executes (1-3 bullets).",
    "integration": "Selective reasoning (integration): note sprite/variable communication or code reuse.",
}
SCHEMA_ONLY = "RETURN ONLY JSON matching this schema:"
UNABLE = 'If you cannot produce valid JSON, return {"error":"parse_failed","raw":<full_response>}'


def snippets(on: list[str] | None, wording: dict[str, str] = SHORT_SNIPPETS) -> list[str]:
    """The lines that ask for reasoning on some dimensions, in the order asked; those without a line are passed over."""
    return [wording[x] for x in on or [] if x in wording]


def generic(examples: Column, schema: str, reason_on: list[str] | None = None, enforce_json: bool = True) -> Column:
    """A prompt without a target: an opening, the examples, asked-for reasoning and, if enforced, the answer's schema."""
    last = [f"{SCHEMA_ONLY} {schema}", UNABLE] if enforce_json else []
    return _blocks(EXPERT, F.nullif(_examples(examples), F.lit("")), *snippets(reason_on, LONG_SNIPPETS), *last)


def variant(examples: Column, schema: str, facts: Column | None = None, reason_on: list[str] | None = None, enforce_json: bool = True, number: int = 0) -> Column:
    """One wording of a prompt over examples that are texts already; facts is an array of short texts."""
    known = F.when(F.size(facts) > 0, F.concat(F.lit("Facts: "), F.array_join(facts, " | "))) if facts is not None else F.lit(None).cast("string")
    last = [f"{SCHEMA_ONLY}\n{schema}", UNABLE] if enforce_json else []
    shown = F.concat(F.lit("Examples:\n"), F.array_join(examples, "\n\n"))
    return _blocks(known, OPENINGS[number] if number in (0, 1) else OPENINGS[2], shown, *snippets(reason_on), *last)


def ensemble(examples: Column, schema: str, facts: Column | None = None, reason_on: list[str] | None = None, n: int = 3) -> Column:
    """array<string>: the first n variants, to be asked side by side and voted on."""
    return F.array(*(variant(examples, schema, facts, reason_on, number=i) for i in range(n)))


def example_texts(examples: Column) -> Column:
    """array<string> of array<struct(features, grades)>, for variant() and ensemble()."""
    return F.transform(examples, lambda x: F.concat_ws("\n", F.lit("Features:"), feature_lines(x["features"]), F.lit("Grades:"), grade_lines(x["grades"])))


def of_records(records: DataFrame, k: int = 3, style: str = "few_shot") -> DataFrame:
    """One row (id, prompt): the first k records by pos are the examples, the next one, or else the last, is the target.

    An unknown style is few_shot. Needs one example and a target that isn't among them.
    """
    n = records.count()
    if n < 2 or k < 1:
        raise ValueError("a prompt needs an example besides its target")
    shown = min(k, n - 1)
    own = F.struct("pos", "id", F.struct(*FEATURES).alias("features"), "grades")
    head = records.select(own.alias("r")).orderBy("r.pos").limit(shown + 1)  # a few rows
    whole = head.agg(F.sort_array(F.collect_list("r")).alias("r"))
    examples = F.transform(F.slice("r", 1, shown), lambda x: F.struct(x["features"].alias("features"), x["grades"].alias("grades")))
    target = F.element_at("r", shown + 1)
    return whole.select(target["id"].alias("id"), target["features"].alias("features"), examples.alias("examples")).select(
        "id", STYLES.get(style, few_shot)(F.col("features"), F.col("examples")).alias("prompt")
    )
