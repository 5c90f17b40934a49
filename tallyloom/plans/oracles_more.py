"""SQL of prompts, constraints, greedy choices and entry points.

Fixed texts, and what they hang on, come from functions.prompt; tests/test_rubric.py holds the texts against digests and the conditions against cases.
"""

from __future__ import annotations

import json
import re

from tallyloom.functions import prompt
from tallyloom.operators.rubric import QUESTIONS
from tallyloom.plans.dims import CATEGORIES, DIMENSIONS, FEATURES, FLAG_FEATURES, SUMMARIES
from tallyloom.plans.guides import ASKED, LEVELS
from tallyloom.plans.oracles import ORACLES as ORACLES_BEFORE
from tallyloom.plans.oracles import _C4, _DIMS, _SCORES, _WIDE, BLOCKS, CONTEXT_ROWS, DEPTH_ROWS, FEATURE_ROWS, PAIRS, _calibrated, _predicted


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(*parts: str, by: str = "\n") -> str:
    return f"concat_ws({_q(by)}, " + ", ".join(parts) + ")"


def _value(f: str, c: str) -> str:
    return f"case when {f}.{c} then 'True' else 'False' end" if c in FLAG_FEATURES else f"{f}.{c}"


def _features(f: str) -> str:
    return _lines(*(f"'  {c}: ' || {_value(f, c)}" for c in FEATURES))


def _grade(f: str, d: str) -> str:
    return f"(({f}.project_id * 7 + {(DIMENSIONS.index(d) + 1) * 5}) % 6)"


def _grades(f: str, dims=DIMENSIONS) -> str:
    return _lines(*(f"'  {d}: ' || {_grade(f, d)}" for d in DIMENSIONS if d in dims))


def _filled(f: str, text: str) -> str:
    out = []
    for i, piece in enumerate(text.replace("}", "{").split("{")):
        if i % 2 == 0:
            out.append(_q(piece))
        elif piece == "variables_note":
            out.append(f"case when {f}.uses_variables then {_q(prompt.VARIABLES_NOTE[0])} else {_q(prompt.VARIABLES_NOTE[1])} end")
        else:
            out.append(f"{f}.{piece}")
    return " || ".join(out)


def _holds(condition: str, f: str) -> str:
    return re.sub(r"\w+", lambda w: f"{f}.{w[0]}" if w[0] in FEATURES else w[0], condition)


def _hints(f: str) -> list[str]:
    return [f"'  - {d}: ' || case when {_holds(when, f)} then {_filled(f, yes)} else {_filled(f, no)} end" for d, when, yes, no in prompt.HINTS]


def _steps(f: str) -> str:
    rows = [f"'  - The project has ' || {f}.sprite_count || ' sprite(s) and ' || {f}.block_count || ' block(s), giving a rough sense of overall complexity.'"]
    for d, when, yes, no in prompt.STEPS:
        rows.append(f"'  - {d} (' || {_grade(f, d)} || '): ' || case when {_holds(when, f)} then {_filled(f, yes)} else {_filled(f, no)} end")
    return _lines(*rows)


def _example(i: int, f: str, dims=DIMENSIONS, think: bool = False) -> str:
    middle = ["'Reasoning:'", _steps(f)] if think else []
    return _lines(f"'Example {i}:'", "'Features:'", _features(f), *middle, "'Grades:'", _grades(f, dims))


def _target(head: str, *more: str) -> str:
    return _lines(_q(head), "'Features:'", _features("t"), *more)


def _blocks(*parts: str) -> str:
    return _lines(*parts, by="\n\n")


def _two(text: str, more: str = "", rest: str = "") -> str:
    """A prompt of every tested record t and its two most similar ones a and b."""
    return f"""with {BLOCKS}, {FEATURE_ROWS}, {PAIRS}
select t.project_id as test_id{more}, {text} as prompt
from banded t join ranked r1 on r1.test_id = t.project_id and r1.rank = 1 join banded a on a.project_id = r1.id
join ranked r2 on r2.test_id = t.project_id and r2.rank = 2 join banded b on b.project_id = r2.id{rest}"""


ONLY = "Return only the grades as a JSON object with the same rubric keys"
_FEW = _blocks(_example(1, "a"), _example(2, "b"), _target("Now grade this new project:"), _q(ONLY + "."))
_COT = _blocks(
    _example(1, "a", think=True), _example(2, "b", think=True),
    _target("Now grade this new project:", _q("\nThink step-by-step about how the features relate to each rubric dimension.\nThen output ONLY the final grades as a strictly valid JSON object with the same rubric keys.")),
)


def _hybrid(examples: list[str]) -> str:
    summary = "RUBRIC SUMMARY (Levels 1–5):\n\n" + "\n".join(f"• {d}: {SUMMARIES[d]}" for d in DIMENSIONS)
    keys = "Required JSON keys (exact, all must be present): [" + ", ".join(f'"{d}"' for d in DIMENSIONS) + "]"
    target = _target("Now grade this new project:", _q("Reasoning (for feature-driven dimensions):"), *_hints("t"), _q(prompt.BALANCE))
    return _blocks(_q(summary), _q(prompt.EVIDENCE_RULES), _q(keys), *examples, target, _q(prompt.FINAL_ONLY))


_GUIDE = "SCORING GUIDE - Rubric Dimensions (1=Novice to 5=Expert):\n" + "".join(f"\nTRUNK-{'0' * (i < 10)}{i}: {d.upper()}\n{LEVELS[d]}\n" for i, d in enumerate(DIMENSIONS, 1))
_QUESTIONS = (
    "QUESTION GUIDE (Levels 1-5):\n\n"
    + "".join(f"{i}. {' '.join(w.capitalize() for w in d.split('_'))}\n" + "".join(f"- {q}\n" for q in ASKED[d]) + "\n" for i, d in enumerate(DIMENSIONS, 1))
    + "Score mapping: 1 = no skill, 2 = partial skill, 3 = correct skill, 4 = efficient skill, 5 = expert skill."
)


def _long_guide(text: str, head: str, last: str) -> str:
    return _blocks(_q(text), _example(1, "a"), _example(2, "b"), _target(head), _q(ONLY + last))


def _category(c: str) -> str:
    dims = CATEGORIES[c]
    head = f"CATEGORY: {c.upper()}\nFocus ONLY on these dimensions: {', '.join(dims)}\n"
    summary = "RUBRIC SUMMARY:\n" + "\n".join(f"• {d}: {SUMMARIES[d]}" for d in dims)
    some = _lines(*(f"case when regexp_matches({h}, '{'|'.join(dims)}') then {h} end" for h in _hints("t")))
    hints = f"case when {some} <> '' then 'Reasoning (for feature-driven dimensions in this category):' || chr(10) || {some} end"
    last = f"Return ONLY a JSON object with integer scores (0–5) for these exact keys: {json.dumps(dims)}. Do NOT include reasoning in the JSON."
    return _two(_blocks(_q(head), _q(summary), _example(1, "a", dims), _example(2, "b", dims), _target("Now grade this new project:", hints), _q(last)), f", '{c}' as category")


_SCHEMA = '{"loops": "0-5", "math": "0-5"}'
_FAILED = 'If you cannot produce valid JSON, return {"error":"parse_failed","raw":<full_response>}'
_GENERIC = _blocks(
    _q(prompt.EXPERT), _example(1, "a"), _example(2, "b"), _q(prompt.LONG_SNIPPETS["algorithms"]), _q(prompt.LONG_SNIPPETS["integration"]),
    _q("RETURN ONLY JSON matching this schema: " + _SCHEMA), _q(_FAILED),
)


def _variant(opening: str) -> str:
    shown = [_lines("'Features:'", _features(f), "'Grades:'", _grades(f)) for f in ("a", "b")]
    return _blocks(
        "'Facts: Fact: blocks ' || t.block_count || ' | Fact: graded by hand'", opening, f"'Examples:' || chr(10) || {shown[0]}", shown[1],
        _q(prompt.SHORT_SNIPPETS["sequencing"]), _q("RETURN ONLY JSON matching this schema:\n" + _SCHEMA), _q(_FAILED),
    )


_OPENING = f"case n.number when 0 then {_q(prompt.OPENINGS[0])} when 1 then {_q(prompt.OPENINGS[1])} else {_q(prompt.OPENINGS[2])} end"
_OF_RECORDS = f"""with {BLOCKS}, {FEATURE_ROWS}, n as (select *, row_number() over (order by project_id) as at from features)
select t.project_id as id, {_hybrid([_example(1, "a"), _example(2, "b"), _example(3, "c")])} as prompt
from n a join n b on a.at = 1 and b.at = 2 join n c on c.at = 3 join n t on t.at = 4"""


# --- hard constraints: one CTE for each step, in order


def _constraints() -> str:
    sees = lambda d, q: f"{d}_{q}"
    true_of = lambda d: "(" + " + ".join(f"cast({d}_{q} as int)" for q in QUESTIONS[d]) + ")"
    flow = sees("sequencing", "clear_start_to_finish_flow")
    event = f"(uses_event_handling or {flow} or {sees('event_handling', 'events_beyond_green_flag')})"
    depth = f"case when {sees('nesting', 'nested_systems_used')} then 4 when {sees('nesting', 'loops_nested')} or {sees('nesting', 'conditionals_nested')} then 2 else 0 end"
    costume, smooth, tied = (sees("animation", q) for q in ("costume_changes_used", "animations_loop_smoothly", "animations_tied_to_game_events"))
    evidence = [sees("algorithms", q) for q in ("step_by_step_strategy", "algorithm_works_for_inputs", "efficiency_considered", "edge_cases_handled")]
    supports = "(" + " + ".join(f"cast({x} as int)" for x in evidence) + ")"
    clone = sees("cloning", "clones_created")
    steps = [
        {
            "cloning": f"if(uses_cloning or {clone}, cloning, 0)",
            "animation": f"if(uses_animation or {costume}, animation, 0)",
            "event_handling": f"if({event}, event_handling, 0)",
            "variables": f"if(uses_variables or {sees('variables', 'variables_used')}, variables, 1)",
            "integration": f"if(uses_integration or {true_of('integration')} > 0, integration, 0)",
        },
        {d: f"case when block_count < 3 then least({d}, 1) when block_count < 7 and {d} = 5 then 4 else {d} end" for d in ("algorithms", "sequencing")},
        {"sequencing": f"case when sequencing >= 4 and not ({sees('sequencing', 'logical_order')} or {flow}) then 3 when sequencing = 1 and ({event} or {flow}) then 2 else sequencing end"},
        {
            "problem_decomposition": f"case when not {sees('problem_decomposition', 'has_subproblems')} then least(problem_decomposition, 2) "
            f"when problem_decomposition >= 4 and not ({sees('problem_decomposition', 'has_hierarchy')} and {sees('problem_decomposition', 'dependencies_explicit')}) then 4 else problem_decomposition end"
        },
        {
            "nesting": f"case when depth <= 1 then least(nesting, 1) when depth = 2 then least(nesting, 3, if(nesting >= 4 and not {sees('nesting', 'nesting_serves_clear_purpose')}, 3, 5)) "
            f"when nesting >= 4 and not {sees('nesting', 'nesting_serves_clear_purpose')} then 3 else nesting end"
        },
        {"animation": f"case when not {costume} then 0 when animation = 5 and not ({smooth} and {tied}) then 4 when animation = 4 and not ({smooth} or {tied}) then 3 else animation end"},
        {
            "algorithms": f"""case when not {evidence[0]} and algorithms >= 3 then 2
              when algorithms >= 4 and {supports} < 3 then 4
              when algorithms >= 5 and block_count < 10 then 4 else algorithms end"""
        },
        {d: f"case when {d} = 5 and {true_of(d)} = 2 then 4 when {d} = 5 and {true_of(d)} < 2 then 3 else {d} end" for d in ("algorithms", "animation", "sequencing", "problem_decomposition", "nesting")},
    ]
    flags = ", ".join(f"f.{c}" for c in FLAG_FEATURES)
    start = ", ".join(f"{_predicted(d)} as {d}" for d in DIMENSIONS).replace("project_id", "f.project_id").replace("block_count", "f.block_count")
    out = f"s0 as (select w.*, f.block_count, {flags}, {depth} as depth, {start} from wide w join features f using (project_id))"
    for i, step in enumerate(steps, 1):
        out += f", s{i} as (select * replace ({', '.join(f'{c} as {d}' for d, c in step.items())}) from s{i - 1})"
    last = " union all ".join(f"select project_id, '{d}' as dimension, cast(greatest(0, least(5, {d})) as int) as predicted from s{len(steps)}" for d in DIMENSIONS)
    return f"with {BLOCKS}, {FEATURE_ROWS}, {DEPTH_ROWS}, {CONTEXT_ROWS}, {_WIDE}, {out} {last}"


# --- greedy choices


def _mmr(k: int, tested: str = "where a.project_id % 100 = 0", of: str = "features") -> str:
    """k picks, each the best of what is left; sums go by whole grades, so that ties are ties on both sides."""
    least = max(2 * k, k + 2)
    pairs = PAIRS.replace("least(8, all_n)", f"least({least}, all_n)").replace("where a.project_id % 100 = 0", tested).replace("from features)", f"from {of})")
    far = " + ".join(f"abs((a.id * 7 + {5 * i}) % 6 - (b.id * 7 + {5 * i}) % 6)" for i in range(1, 21))
    out = f"""with {BLOCKS}, {FEATURE_ROWS}, {pairs}, m as (select test_id, avg(similarity) as m, stddev_pop(similarity) as s from top where rank <= 8 group by 1),
v as (select *, case when m > 0 then s / m else 0 end as cv from m),
w0 as (select test_id, m, case when cv <= 0.12 then 0.62 when cv >= 0.35 then 0.84 else 0.62 + 0.22 * (cv - 0.12) / 0.23 end as w from v),
w as (select test_id, cast(case when m < 12 then least(0.9, w + 0.04) else w end as double) as w from w0),
p1 as (select test_id, 1 as rank, id, similarity from top where rank = 1)"""
    picked = "p1"
    for i in range(2, k + 1):
        out += f""", c{i} as (
  select a.test_id, a.id, any_value(a.similarity) as similarity, min({far}) / 20.0 as far
  from pool a join ({picked}) b using (test_id) where not exists (select 1 from ({picked}) x where x.test_id = a.test_id and x.id = a.id) group by 1, 2
), p{i} as (
  select c.test_id, {i} as rank, c.id, c.similarity from c{i} c join w using (test_id)
  qualify row_number() over (partition by c.test_id order by round(w * c.similarity + (1 - w) * c.far, 9) desc, c.id) = 1
)"""
        picked = " union all ".join(f"select * from p{j}" for j in range(1, i + 1))
    return out.replace("(p1)", "(select * from p1)") + f" select test_id, rank, id, round(similarity, 6) as similarity from ({picked})"


_BALANCED = """with recursive records as (
  select c_custkey as pos, list_transform(range(1, 21), lambda i: cast(pow(2, (c_custkey * (i + 6) + i * i) % 6) as int)) as bits from customer
), picks as (
  select 0 as step, cast([] as bigint[]) as chosen, list_transform(range(1, 21), lambda i: 0) as have
  union all
  select step + 1, list_append(any_value(chosen), arg_max(pos, [worth, -pos])), arg_max(after, [worth, -pos])
  from (
    select step, chosen, pos, after,
      list_sum(list_transform(after, lambda x: bit_count(x) + case when bit_count(x) = 5 then 100 else 0 end)) as worth
    from (select step, chosen, pos, list_transform(range(1, 21), lambda i: have[i] | bits[i]) as after from picks, records where step < 15 and not list_contains(chosen, pos))
  ) group by step
)
select unnest(chosen) as id from picks where step = 15"""


# --- entry points

_CLASSES = "select class, count(*) filter (actual = class and predicted = class) as tp, count(*) filter (predicted = class) as p, count(*) filter (actual = class) as a from facts, range(6) c(class) group by 1"


def _summary(facts: str, samples: str) -> str:
    return f"""with {facts}, classes as ({_CLASSES}), prf as (
  select class, case when p > 0 then tp / p else 0 end as precision, case when a > 0 then tp / a else 0 end as recall from classes
), metrics as (
  select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from prf
), shares as (
  select k, (select count(*) from facts where actual = k) / (select count(*) from facts) as x, (select count(*) from facts where predicted = k) / (select count(*) from facts) as y from range(6) r(k)
), chance as (select sum(x * y) as e from shares), hits as (select avg(case when actual = predicted then 1.0 else 0.0 end) as o from facts), long as (
  select 'num_samples' as metric, null as key, count(distinct {samples}) as value from facts
  union all select 'num_dimensions', null, count(distinct dimension) from facts
  union all select 'accuracy', null, 100 * o from hits
  union all select 'kappa', null, (o - e) / (1 - e) from hits, chance
  union all select 'macro_precision', null, avg(precision) from metrics
  union all select 'macro_recall', null, avg(recall) from metrics
  union all select 'macro_f1', null, avg(f1) from metrics
  union all select 'mae_by_dimension', dimension, avg(abs(actual - predicted)) from facts group by dimension
  union all select 'precision_by_class', cast(class as varchar), precision from metrics
  union all select 'recall_by_class', cast(class as varchar), recall from metrics
  union all select 'f1_by_class', cast(class as varchar), f1 from metrics
) select metric, key, round(cast(value as double), 6) as value from long"""


_SHEET = """sheet as (
  select project_id as n, unnest(case when project_id % 10 = 0 then [1, 2] else [1] end) as reviewer from projects
), listed as (
  select n, reviewer, row_number() over (order by n, reviewer) - 1 as pos from sheet where n % 50 <> 1
)"""
_CONTRASTIVE = """with r as (
  select c_custkey as id, (c_custkey * 9 + 9) % 6 as g, md5('42:' || c_custkey) as h from customer
), d as (select g, row_number() over (order by g) - 1 as place, count(*) over () as n from (select distinct g from r)),
s as (select id, h, case when place <= n // 2 then 'low' end as low, case when place > n // 2 or (place = n - 1 and n // 2 = n - 1) then 'high' end as high from r join d using (g)),
p as (
  (select id from s where low is not null order by h, id limit 3) union all (select id from s where high is not null order by h, id limit 3)
) select id from p"""

_ENRICHED = f"{_DIMS}, {BLOCKS}, {FEATURE_ROWS}, {DEPTH_ROWS}, {CONTEXT_ROWS}, {_WIDE}, {_SCORES}, {_SHEET}"
_MARK = "case when (n + dim_idx + reviewer) % 7 = 6 then 0 else (n + dim_idx + reviewer) % 7 end"
_STORED = f"{_ENRICHED}, facts as (select pos, n as sample_id, dimension, {_MARK} as actual, score as predicted from listed join scores on project_id = n join dims using (dimension))"

#: Every record's two examples are the first two others; the answer hangs on the prompt's length.
_ALL_FEW = f"""{BLOCKS}, {FEATURE_ROWS}, n as (select *, row_number() over (order by project_id) as at from features), asked as (
  select t.*, length({_FEW}) as long from n t join n a on a.at = case when t.at = 1 then 2 else 1 end join n b on b.at = case when t.at <= 2 then 3 else 2 end
)"""


def _held_out() -> str:
    body = _calibrated("v1").split(FEATURE_ROWS, 1)[1]
    for d in DIMENSIONS:
        body = body.replace(_predicted(d), "(1 + long % 5)")
    body = body.replace("select project_id,", "select project_id, block_count as _b,").replace("from features", "from asked")
    return f"with {_DIMS}, {_ALL_FEW}, given as ({body}), facts as (select project_id as sample_id, dimension, cast((project_id * 7 + dim_idx * 5) % 6 as int) as actual, predicted from given join dims using (dimension))"


def _held_out_by_choice(text: str, of: str, blended: bool) -> str:
    """Every record of `of` with its two MMR picks a and b; the answer hangs on the prompt's length."""
    picks = _mmr(2, "", of)
    ends = "(" + picks.removeprefix(f"with {BLOCKS}, {FEATURE_ROWS}, ").rsplit(" select test_id, rank", 1)[1]
    chosen = picks.rsplit(" select test_id, rank", 1)[0] + ", picked as (select * from " + ends.split(" from ", 1)[1] + ")"
    out = f"""{chosen}, asked as (
  select t.project_id, t.block_count, {", ".join(f"t.{c}" for c in FEATURES if c != "block_count")}, 1 + length({text}) % 5 as said,
    r1.id as id1, r2.id as id2, r1.similarity as s1, r2.similarity as s2
  from banded t join picked r1 on r1.test_id = t.project_id and r1.rank = 1 join banded a on a.project_id = r1.id
  join picked r2 on r2.test_id = t.project_id and r2.rank = 2 join banded b on b.project_id = r2.id
)"""
    if blended:
        share = lambda k: f"(s{k} - least(s1, s2) + cast(1e-6 as double))"
        prior = f"({share(1)} * ((id1 * 7 + dim_idx * 5) % 6) + {share(2)} * ((id2 * 7 + dim_idx * 5) % 6)) / ({share(1)} + {share(2)})"
        predicted = f"cast(greatest(0, least(5, round_even(cast(0.6 as double) * said + cast(0.4 as double) * {prior}, 0))) as int)"
        body = f"select project_id, dimension, {predicted} as predicted from asked, dims"
    else:
        body = _calibrated("v1").split(FEATURE_ROWS, 1)[1].replace("from features", "from asked")
        for d in DIMENSIONS:
            body = body.replace(_predicted(d), "said")
    return (
        f"with {_DIMS}, {out.removeprefix('with ')}, given as ({body}) select project_id as sample_id, dimension, cast((project_id * 7 + dim_idx * 5) % 6 as int) as actual, predicted"
        " from given join dims using (dimension)"
    )


def _category_text(c: str) -> str:
    return _category(c).split(" as category, ", 1)[1].rsplit(" as prompt", 1)[0]


_OPS_SET = "contains(lower(opcode), 'set') or contains(lower(opcode), 'create_variable') or contains(lower(opcode), 'init')"

ORACLES = {
    "leave_one_out_batched": _held_out_by_choice(_category_text(list(CATEGORIES)[-1]), "features", False),
    "leave_one_out_blended": _held_out_by_choice(_hybrid([_example(1, "a"), _example(2, "b")]), "(select * from features order by project_id limit 200) f", True),
    "clone_handlers": f"""with {BLOCKS} select project_id, bool_or(contains(opcode, 'clone') and contains(opcode, 'create')) as clone_create,
  bool_or(contains(opcode, 'start_as_clone')) as clone_start from blocks group by 1""",
    "initialised_variables": f"""with {BLOCKS}, n as (
  select project_id, opcode, row_number() over (partition by project_id order by block_id) as place,
    case when opcode = 'data_setvariableto' then case k % 4 when 0 then 'score' when 1 then 'var' || k when 2 then 'lives' else 'speed' end end as variable
  from blocks
), v as (select project_id, list_sort(list_distinct(list(variable) filter (({_OPS_SET}) and variable is not null and place <= 20))) as names from n group by 1)
select project_id, coalesce(len(names), 0) as num_var_inited, coalesce(array_to_string(names[1:5], ','), '') as sample from v""",
    "json_depths": f"with {BLOCKS} select project_id, case when bool_or(opcode in ('event_broadcast', 'event_whenbroadcastreceived')) then 7 else 5 end as depth from blocks group by 1",
    "sheet_round_trip": ORACLES_BEFORE["label_grades_long"],
    "map_round_trip": ORACLES_BEFORE["confusion_map"],
    "dataset_round_trip": "select c_custkey as id, cast(c_custkey % 7 as double) / 4 as x, 'say \"{' || (c_custkey % 5) || '}]\\' as t, [c_custkey % 3, 2] as g from customer",
    "predictions_round_trip": ORACLES_BEFORE["confusion_remap"],
    "hard_constraints": _constraints(),
    "mmr_pick_k2": _mmr(2),
    "mmr_pick": _mmr(3),
    "balanced_pick": _BALANCED,
    "contrastive_pick": _CONTRASTIVE,
    "prompt_few_shot": _two(_FEW),
    "prompt_chain_of_thought": _two(_COT),
    "prompt_hybrid": _two(_hybrid([_example(1, "a"), _example(2, "b")])),
    "prompt_rubric_reference": _two(_long_guide(_GUIDE, "Now grade this new project using the rubric guide above:", ", referring to the scoring guide for each dimension.")),
    "prompt_question_based": _two(_long_guide(_QUESTIONS, "Now grade this new project using the question guide above:", ", using the question guide and the score mapping above.")),
    "prompt_category": "select * from (" + ") union all select * from (".join(_category(c) for c in CATEGORIES) + ")",
    "prompt_generic": _two(_GENERIC),
    "prompt_ensemble": _two(_variant(_OPENING), ", n.number", ", (values (0), (1), (2)) n(number)"),
    "prompt_of_records": _OF_RECORDS,
    "provider_grades": f"with {_DIMS}, p as ({_two(_FEW)}) select test_id, dimension, 1 + length(prompt) % 5 as grade from p, dims",
    "response_server": f"""with {_C4} select conv_id, turn, case (conv_id + turn) % 5 when 0 then '' || g when 1 then '' || g when 3 then 'g' end as loops,
  case (conv_id + turn) % 5 when 0 then '2.9' when 3 then 'true' end as math, case (conv_id + turn) % 5 when 1 then '4' when 3 then '' || g end as lists,
  case when (conv_id + turn) % 5 in (2, 4) then trim(response) end as raw_response from answers""",
    "enriched_records": f"""with {_ENRICHED}, s as (select project_id, string_agg(score, ',' order by dim_idx) as scores from scores join dims using (dimension) group by 1),
g as (select n, reviewer, string_agg({_MARK}, ',' order by dim_idx) as grades from listed, dims group by 1, 2)
select pos, n as id, grades, {", ".join(FEATURES)}, scores from listed join g using (n, reviewer) join s on s.project_id = n join features f on f.project_id = n""",
    "stored_evaluation": _summary(_STORED, "pos"),
    "leave_one_out": _held_out() + " select sample_id, dimension, actual, predicted from facts",
    "leave_one_out_summary": _summary(_held_out().removeprefix("with "), "sample_id"),
}
