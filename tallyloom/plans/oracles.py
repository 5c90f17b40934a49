"""The same results in SQL for DuckDB, over the tables alone. Names come from plans.dims, the rubric's rules from the one table of operators.rubric,
which tests/test_rubric.py holds against hand-made cases."""

from __future__ import annotations

import re

from tallyloom.operators.rubric import LADDERS, QUESTIONS
from tallyloom.operators.scoring import CAPS
from tallyloom.plans.corpus import OPCODES
from tallyloom.plans.dims import DIMENSIONS, FEATURES, FLAG_FEATURES

_DIMS = "dims(dim_idx, dimension) as (values " + ", ".join(f"({i}, '{d}')" for i, d in enumerate(DIMENSIONS, 1)) + ")"
_OPS = ", ".join(f"'{x}'" for x in OPCODES)

BLOCKS = f"""
blocks0 as (
  select case when user_id % 5 = 0 then user_id * 10 else user_id * 10 + 1 + event_id % 6 end as project_id,
    event_id % 4 as target_idx, event_id as block_id, ts, cast(json_extract_string(props, '$.k') as bigint) as k,
    ([{_OPS}])[(event_id * 7 + user_id * 13 + cast(floor(value) as bigint)) % 32 + 1] as opcode
  from events
), blocks as (
  select *, case target_idx when 0 then 'Stage' when 3 then 'Game Over' else 'Sprite' || target_idx end as target_name,
    lag(block_id) over (partition by project_id, target_idx order by ts, block_id) as parent_id,
    case when opcode = 'data_setvariableto' then case k % 4 when 0 then 'score' when 1 then 'var' || k when 2 then 'lives' else 'speed' end end as variable,
    case when opcode = 'data_addtolist' then case when k % 3 = 0 then 'list1' else 'inventory' || (k % 3) end end as listed,
    case when opcode in ('event_broadcast', 'event_whenbroadcastreceived') then 'msg' || (k % 5) end as said,
    case when opcode = 'pen_stamp' then case k % 3 when 0 then 'debug me' when 1 then 'Fix the component' else 'note' end end as comment
  from blocks0
), projects as (select distinct project_id from blocks)"""


def _like(*prefixes: str) -> str:
    return "(" + " or ".join(f"starts_with(opcode, '{p}')" for p in prefixes) + ")"


_LOOP, _COSTUME = ("control_repeat", "control_forever"), ("looks_switchcostumeto", "looks_nextcostume")
_UI = "(starts_with(opcode, 'looks_') and regexp_matches(opcode, 'say|think|change|set'))"

FEATURE_ROWS = f"""
names as (
  select project_id, target_idx, 'variable' as kind, variable as name from blocks where variable is not null
  union select project_id, target_idx, 'list', listed from blocks where listed is not null
), named as (
  select project_id, count(*) filter (kind = 'variable') as nv, count(*) filter (kind = 'list') as nl from names group by 1
), features as (
  select b.project_id, count(distinct target_idx) filter (target_idx <> 0) as sprite_count, count(*) as block_count,
    coalesce(any_value(nv), 0) as variable_count, coalesce(any_value(nl), 0) as list_count,
    bool_or({_like(*_LOOP)}) as uses_loops, bool_or({_like("control_if")}) as uses_conditionals,
    bool_or({_like("data_", "argument_")}) or coalesce(any_value(nv), 0) > 0 as uses_variables,
    bool_or({_like("event_")}) as uses_event_handling, bool_or({_like("control_create_clone_of")}) as uses_cloning,
    bool_or({_like("sensing_touching")}) as uses_collision, bool_or({_like(*_COSTUME)}) as uses_animation,
    bool_or({_like("sound_")}) as uses_sound, bool_or({_UI}) as uses_ui_feedback,
    bool_or({_like("data_list")}) or coalesce(any_value(nl), 0) > 0 as uses_lists,
    bool_or(regexp_matches(opcode, 'operator_|math_|data_changevariableby')) as uses_math,
    bool_or({_like("event_broadcast")}) as uses_messaging, count(*) >= 5 as uses_algorithms,
    bool_or({_like(*_LOOP)}) and bool_or({_like("control_if")}) as uses_nesting,
    count(distinct target_idx) filter (target_idx <> 0) > 0 and count(*) >= 3 and bool_or({_like("event_")})
      and (bool_or({_like("data_", "argument_")}) or coalesce(any_value(nv), 0) > 0) as uses_integration
  from blocks b left join named using (project_id) group by b.project_id
)"""

_CONTROL = _like("control_repeat", "control_forever", "control_if")
#: A block's parent is the one before it on its target, so its control ancestors are the control blocks that precede it there.
DEPTH_ROWS = f"""
ordered as (
  select project_id, target_idx, block_id, opcode, {_CONTROL} as control,
    coalesce(sum(case when {_CONTROL} then 1 else 0 end) over w, 0) as depth,
    {_CONTROL} and coalesce(lag({_CONTROL}) over (partition by project_id, target_idx order by ts, block_id), false) as nested
  from blocks
  window w as (partition by project_id, target_idx order by ts, block_id rows between unbounded preceding and 1 preceding)
), depths as (
  select project_id, cast(max(depth) as bigint) as depth, count(*) filter (nested) as nested from ordered group by 1
)"""


def _n(condition: str, name: str) -> str:
    return f"count(*) filter ({condition}) as {name}"


def _b(condition: str, name: str) -> str:
    return f"bool_or({condition}) as {name}"


_MOVES = "'motion_gotoxy', 'motion_glidesecstoxy', 'motion_setx', 'motion_sety'"
CONTEXT_ROWS = f"""
names_c as (
  select project_id, count(*) filter (kind = 'variable') as variable_name_count, count(*) filter (kind = 'list') as list_name_count,
    bool_or(kind = 'variable' and not regexp_matches(lower(name), '^(var|item|list)')) as named_variable,
    bool_or(kind = 'list' and not regexp_matches(lower(name), '^(list|item)')) as named_list,
    bool_or(kind = 'variable' and lower(name) in ('score', 'scores', 'lives', 'life', 'timer', 'time', 'health', 'hp')) as state_variable
  from names group by 1
), blocks_c as (
  select project_id, count(*) as block_count, count(distinct target_idx) filter (target_idx <> 0) as sprite_count,
    bool_or(lower(target_name) not in ('sprite1', 'sprite2', 'sprite3', 'stage')) as named_target,
    bool_or(regexp_matches(lower(target_name), 'start|end|game over|menu')) as screen_target,
    {_n(_like("control_if"), "conditional_count")}, {_n(_like("control_if_else"), "if_else_count")}, {_n(_like(*_LOOP), "loop_count")},
    {_n(_like("procedures_definition"), "procedure_definition_count")}, {_n(_like("procedures_call"), "procedure_call_count")},
    {_n(_like(*_COSTUME), "costume_switch_count")}, {_n(_like("control_wait"), "wait_count")}, {_n(_like("operator_"), "operator_count")},
    {_n(_like("event_broadcast"), "broadcast_send_count")}, {_n(_like("event_whenbroadcastreceived"), "broadcast_receive_count")},
    {_b(_like("event_"), "has_event")}, {_b(_like("event_when") + " and opcode <> 'event_whenflagclicked'", "has_other_event")},
    {_b(_like(*_LOOP), "has_loop")}, {_b(_like("control_if"), "has_conditional")}, {_b(_like("data_", "argument_"), "has_data")},
    {_b(_like("event_broadcast"), "has_broadcast")}, {_b(_like("procedures_"), "has_procedure")},
    {_b(f"opcode in ({_MOVES}, 'motion_changexby', 'motion_changeyby')", "has_coordinate")}, {_b(f"opcode in ({_MOVES})", "has_absolute_move")},
    {_b("opcode in ('motion_changexby', 'motion_changeyby')", "has_relative_move")}, {_b("opcode = 'motion_ifonedgebounce'", "has_edge_bounce")},
    {_b(_like("control_create_clone_of"), "has_clone")}, {_b(_like("sensing_touching"), "has_collision")}, {_b(_like("sound_"), "has_sound")},
    {_b(_UI, "has_ui_feedback")}, {_b(_like("looks_say", "looks_think"), "has_message")}, {_b(_like("data_list"), "has_data_list")},
    {_b("regexp_matches(opcode, 'operator_|math_')", "has_operator")}, {_b("opcode in ('operator_and', 'operator_or', 'operator_not')", "has_compound")},
    {_b("opcode in ('data_addtolist', 'data_deleteoflist', 'data_deletealloflist', 'data_insertatlist', 'data_replaceitemoflist')", "has_list_update")},
    {_b("opcode in ('data_itemoflist', 'data_itemnumoflist', 'data_lengthoflist', 'data_listcontainsitem')", "has_list_access")},
    count(distinct opcode) filter ({_like("event_when")}) as event_type_count,
    count(distinct target_name) filter ({_like("event_when")}) as handler_count,
    count(distinct said) as broadcast_name_count, count(distinct said) as descriptive_broadcast_count,
    count(comment) as comment_count, coalesce(bool_or(contains(lower(comment), 'component')), false) as comment_part,
    coalesce(bool_or(contains(lower(comment), 'debug')), false) as comment_debug, coalesce(bool_or(contains(lower(comment), 'fix')), false) as comment_fix
  from blocks group by 1
), context as (
  select b.*, depth as max_control_nesting_depth, nested as nested_control_count,
    coalesce(variable_name_count, 0) as variable_name_count, coalesce(list_name_count, 0) as list_name_count,
    coalesce(named_variable, false) as named_variable, coalesce(named_list, false) as named_list, coalesce(state_variable, false) as state_variable,
    has_data or coalesce(variable_name_count, 0) > 0 as has_variable, has_data_list or coalesce(list_name_count, 0) > 0 as has_list
  from blocks_c b join depths using (project_id) left join names_c using (project_id)
)"""

_ANSWERS = "answers as (" + " union all ".join(
    f"select project_id, '{d}' as dimension, '{q}' as question, cast({rule} as boolean) as answer from context" for d, rules in QUESTIONS.items() for q, rule in rules.items()
) + ")"


def _score(d: str) -> str:
    asked = QUESTIONS[d]
    n = "(" + " + ".join(f"cast({d}_{q} as int)" for q in asked) + ")"
    if d not in LADDERS:
        fifths = " ".join(f"when {n} / {len(asked)}.0 <= {k / 5} then {k + 1}" for k in (1, 2, 3))
        return f"case when {n} = 0 then 1 {fifths} else 5 end"
    said = lambda condition: re.sub(r"\w+", lambda w: f"{d}_{w[0]}" if w[0] in asked else n if w[0] == "n" else w[0], condition)
    return "case " + " ".join(f"when {said(condition)} then {value}" for condition, value in LADDERS[d]) + " end"


_WIDE = "wide as (select project_id, " + ", ".join(f"{rule} as {d}_{q}" for d, rules in QUESTIONS.items() for q, rule in rules.items()) + " from context)"
_SCORES = "scores as (" + " union all ".join(f"select project_id, '{d}' as dimension, {_score(d)} as score from wide" for d in DIMENSIONS) + ")"

C2 = f"""{_DIMS}, facts0 as (
  select c_custkey as sample_id, dim_idx, dimension, (c_custkey * 7 + dim_idx * 3) % 6 as actual from customer, dims
), facts as (
  select *, (actual + case when sample_id * dim_idx % 4 = 0 then 1 else 0 end) % 6 as predicted from facts0
)"""
C3 = C2 + ", passes as (select sample_id, dimension, pass, (actual + (sample_id + pass * dim_idx) % 4) % 6 as predicted from facts, (values (0), (1), (2)) p(pass))"
C5 = "sheet as (select o_orderkey as ID, case when o_orderkey % 3 <> 0 then 'https://example.com/projects/' || o_custkey || '/' end as URL from orders)"
_CLASSES = """classes as (
  select class, count(*) filter (actual = class and predicted = class) as tp, count(*) filter (predicted = class) as p, count(*) filter (actual = class) as a
  from facts, range(6) c(class) group by 1
), prf as (
  select cast(class as int) as class, case when p > 0 then tp / p else 0 end as precision, case when a > 0 then tp / a else 0 end as recall from classes
), metrics as (
  select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from prf
)"""


def _predicted(d: str) -> str:
    return f"(project_id * 7 + {DIMENSIONS.index(d) + 1} * 3 + block_count) % 6"


def _calibrated(mode: str) -> str:
    parts = []
    for d in DIMENSIONS:
        caps = [f"case when {condition} then {cap} else 9 end" for m, condition, dim, cap in CAPS if dim == d and (m == "v1" or mode == "v2")]
        p = _predicted(d)
        value = f"case when {p} < 4 then least({', '.join([p, *caps])}) else {p} end"
        parts.append(f"select project_id, '{d}' as dimension, cast({value} as int) as predicted from features")
    return f"with {BLOCKS}, {FEATURE_ROWS} " + " union all ".join(parts)


_COMPLEXITY = "sprite_count * 1.2 + block_count / 25.0 + variable_count * 1.5 + list_count * 2.0 + 2.2 * (" + " + ".join(f"cast({c} as int)" for c in FLAG_FEATURES) + ")"
_BAND = f"case when {_COMPLEXITY} < 28 then 0 when {_COMPLEXITY} < 52 then 1 else 2 end"


def _near(c: str, w: float) -> str:
    return f"{w} * (1 - abs(a.{c} - b.{c}) / greatest(abs(a.{c}), abs(b.{c}), 1))"


def _same(c: str, w: float) -> str:
    return f"case when a.{c} is not distinct from b.{c} then {w} else 0 end"


_SIMILARITY = " + ".join(
    [_same(c, 2.0) for c in FLAG_FEATURES]
    + [_near(c, 1.0) for c in FEATURES[:4]]
    + [_same(c, 1.8) for c in ("uses_loops", "uses_conditionals", "uses_algorithms", "uses_nesting", "uses_math")]
    + [_near("block_count", 1.0)]
    + [_same(c, 2.0) for c in ("uses_event_handling", "uses_messaging", "uses_ui_feedback")]
    + [_near("sprite_count", 1.1)]
    + [_same(c, 1.7) for c in ("uses_variables", "uses_lists", "uses_math")]
    + [_near("variable_count", 1.0), _near("list_count", 1.0)]
)
PAIRS = f"""banded as (select *, {_BAND} as band from features), pairs as (
  select a.project_id as test_id, b.project_id as id, a.band as test_band, b.band as band, cast({_SIMILARITY} as double) as similarity
  from banded a join banded b on a.project_id <> b.project_id where a.project_id % 100 = 0
), counted as (
  select test_id, count(*) as all_n, count(*) filter (band = test_band) as same, count(*) filter (abs(band - test_band) <= 1) as near from pairs group by 1
), pool as (
  select p.* from pairs p join counted using (test_id)
  where case when same >= least(8, all_n) then band = test_band when near >= least(8, all_n) then abs(band - test_band) <= 1 else true end
), ranked as (
  select *, row_number() over (partition by test_id order by similarity desc, id) as rank from pairs
), top as (
  select *, row_number() over (partition by test_id order by similarity desc, id) as rank from pool
)"""
_C4 = """answers as (
  select conv_id, turn, turn % 6 as g, case (conv_id + turn) % 5
    when 0 then 'Sure:' || chr(10) || '```json' || chr(10) || '{"loops": ' || (turn % 6) || ', "math": 2.9}' || chr(10) || '```'
    when 1 then 'Result {"loops": ' || (turn % 6) || ', "lists": 4} done'
    when 2 then '{"loops": ' || (turn % 6) || ', '
    when 3 then '{"loops": "g", "math": true, "lists": ' || (turn % 6) || '}'
    else 'no grades here' end as response
  from conversations
), found as (
  select conv_id, turn, response, regexp_extract(response, '\\{[\\s\\S]*\\}') as inner_text from answers
)"""

ORACLES: dict[str, str] = {
    "eval_mae_by_dimension": f"with {C2} select dimension, round(avg(abs(actual - predicted)), 6) as mae from facts group by 1",
    "eval_accuracy": f"with {C2}, s as (select sample_id, 100.0 * count(*) filter (actual = predicted) / 20 as m from facts group by 1) select round(avg(m), 6) as accuracy from s",
    "eval_kappa": f"""with {C2}, a as (select actual as c, count(*) / (select count(*) from facts) as x from facts group by 1),
p as (select predicted as c, count(*) / (select count(*) from facts) as y from facts group by 1),
e as (select sum(coalesce(x, 0) * coalesce(y, 0)) as e from a full join p using (c)),
o as (select avg(case when actual = predicted then 1.0 else 0.0 end) as o from facts)
select round((o - e) / (1 - e), 6) as kappa from o, e""",
    "eval_class_prf": f"with {C2}, {_CLASSES} select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from metrics",
    "eval_macro": f"with {C2}, {_CLASSES} select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1 from metrics",
    "eval_confusion": f"with {C2} select dimension, 'actual_' || actual || '->pred_' || predicted as cell, count(*) as n from facts group by 1, 2",
    "eval_sample_errors": f"with {C2} select sample_id, 100.0 * count(*) filter (actual = predicted) / 20 as exact_match_percent, "
    + ", ".join(f"cast(max(abs(actual - predicted)) filter (dimension = '{d}') as int) as {d}" for d in DIMENSIONS)
    + " from facts group by 1",
    "pred_clamp": f"""with {C2} select sample_id, dimension, cast(case when sample_id % 5 in (0, 1) then 0
else greatest(0, least(5, trunc((sample_id * dim_idx) % 19 - 6 + 0.5))) end as int) as predicted from facts""",
    "confusion_map": f"""with {C2}, n as (select dimension, predicted, actual, count(*) as n, min(sample_id) as first from facts group by all)
select dimension, predicted, actual as remapped from n qualify row_number() over (partition by dimension, predicted order by n desc, first, actual) = 1""",
    "confusion_remap": f"""with {C2}, n as (select dimension, predicted, actual, count(*) as n, min(sample_id) as first from facts group by all),
m as (select dimension, predicted, actual as remapped from n qualify row_number() over (partition by dimension, predicted order by n desc, first, actual) = 1)
select sample_id, dimension, coalesce(remapped, predicted) as predicted from facts left join m using (dimension, predicted)""",
    "vote_majority": f"""with {C3}, n as (select sample_id, dimension, predicted, count(*) as n from passes group by all),
m as (select sample_id, dimension, avg(predicted) as mean from passes group by all)
select sample_id, dimension, predicted from n join m using (sample_id, dimension)
qualify row_number() over (partition by sample_id, dimension order by n desc, abs(predicted - mean), predicted) = 1""",
    "vote_median": f"with {C3} select sample_id, dimension, cast(round_even(median(predicted), 0) as bigint) as predicted from passes group by all",
    "vote_mean": f"with {C3} select sample_id, dimension, cast(round_even(avg(predicted), 0) as bigint) as predicted from passes group by all",
    "vote_pass_means": f"with {C3} select sample_id, dimension, round(avg(predicted), 6) as mean, cast(round_even(avg(predicted), 0) as bigint) as rounded from passes group by all",
    "label_ids": f"with {C5} select ID, coalesce(cast(nullif(regexp_extract(URL, '/projects/(\\d+)', 1), '') as bigint), ID) as project_id from sheet",
    "label_grades_long": f"""with {_DIMS} select case when o_orderkey % 3 <> 0 then o_custkey else o_orderkey end as project_id, dimension,
cast(case when (o_orderkey + dim_idx) % 7 = 6 then 0 else (o_orderkey + dim_idx) % 7 end as int) as actual from orders, dims""",
    "project_features": f"with {BLOCKS}, {FEATURE_ROWS} select * from features",
    "project_context": f"with {BLOCKS}, {FEATURE_ROWS}, {DEPTH_ROWS}, {CONTEXT_ROWS} select * from context",
    "nesting_depth": f"with {BLOCKS}, {DEPTH_ROWS} select * from depths",
    "atomic_answers_long": f"with {BLOCKS}, {FEATURE_ROWS}, {DEPTH_ROWS}, {CONTEXT_ROWS}, {_ANSWERS} select * from answers",
    "scores_all_dims": f"with {BLOCKS}, {FEATURE_ROWS}, {DEPTH_ROWS}, {CONTEXT_ROWS}, {_WIDE}, {_SCORES} select * from scores",
    "score_distribution": f"with {BLOCKS}, {FEATURE_ROWS}, {DEPTH_ROWS}, {CONTEXT_ROWS}, {_WIDE}, {_SCORES} select dimension, score, count(*) as projects from scores group by 1, 2",
    "calibrate_v1": _calibrated("v1"),
    "calibrate_v2": _calibrated("v2"),
    "complexity_band": f"with {BLOCKS}, {FEATURE_ROWS} select project_id, round(cast({_COMPLEXITY} as double), 6) as complexity, {_BAND} as band from features",
    "similarity_top8": f"with {BLOCKS}, {FEATURE_ROWS}, {PAIRS} select test_id, id, rank, round(similarity, 6) as similarity from ranked where rank <= 8",
    "candidate_pool": f"with {BLOCKS}, {FEATURE_ROWS}, {PAIRS} select test_id, count(*) as candidates, cast(sum(id) as bigint) as id_sum from pool group by 1",
    "mmr_weights": f"""with {BLOCKS}, {FEATURE_ROWS}, {PAIRS}, m as (select test_id, avg(similarity) as m, stddev_pop(similarity) as s from top where rank <= 8 group by 1),
v as (select *, case when m > 0 then s / m else 0 end as cv from m),
w as (select test_id, m, case when cv <= 0.12 then 0.62 when cv >= 0.35 then 0.84 else 0.62 + 0.22 * (cv - 0.12) / 0.23 end as w from v),
x as (select test_id, cast(case when m < 12 then least(0.9, w + 0.04) else w end as double) as w from w)
select test_id, round(w, 6) as similarity_weight, round(1 - w, 6) as diversity_weight from x""",
    "first_k_examples": f"""with {BLOCKS}, p as (
  select a.project_id as test_id, b.project_id as id, row_number() over (partition by a.project_id order by b.project_id) as rank
  from projects a join projects b on a.project_id <> b.project_id where a.project_id % 100 = 0
) select test_id, rank, id from p where rank <= 3""",
    "retrieval_blend": f"""with {_DIMS}, {BLOCKS}, {FEATURE_ROWS}, {PAIRS}, e as (
  select test_id, id, similarity - min(similarity) over (partition by test_id) + 1e-6 as share from ranked where rank <= 3
), prior as (select test_id, dim_idx, dimension, sum(share * ((id * 7 + dim_idx * 5) % 6)) / sum(share) as prior from e, dims group by all)
select test_id, dimension, cast(greatest(0, least(5, round_even(cast(0.6 as double) * ((test_id + dim_idx) % 6) + cast(0.4 as double) * prior, 0))) as int) as predicted from prior""",
    "response_grades": f"""with {_C4}, o as (
  select conv_id, turn, cast(inner_text as json) as j from found where inner_text <> '' and json_valid(inner_text)
), e as (
  select conv_id, turn, unnest(json_keys(j)) as dimension, j from o
), t as (
  select conv_id, turn, dimension, json_extract(j, '$.' || dimension) as v from e
)
select conv_id, turn, dimension, case when json_type(v) = 'BOOLEAN' then cast(cast(v as boolean) as int) else cast(trunc(cast(v as double)) as int) end as grade
from t where json_type(v) in ('BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE')""",
    "response_sanitized": """with a as (
  select conv_id, turn, (conv_id + turn) % 5 as c from conversations
)
select conv_id, turn, case c when 2 then 'no_json_found' when 4 then 'no_json_found' end as error,
  case c when 0 then '{"loops":' || (turn % 6) || ',"math":2.9}' when 1 then '{"lists":4,"loops":' || (turn % 6) || '}'
    when 3 then '{"lists":' || (turn % 6) || ',"loops":"g","math":true}' end as json,
  case c when 0 then cast(turn % 6 as varchar) when 1 then cast(turn % 6 as varchar) when 3 then 'g' end as loops
from a""",
    "response_confidence": """select conv_id, turn, case turn % 4
  when 0 then (conv_id % 10) / 10 when 1 then 1 when 2 then case when conv_id % 10 = 0 then 1 else 0 end else (conv_id % 10) / 10 end as confidence
from conversations""",
}
