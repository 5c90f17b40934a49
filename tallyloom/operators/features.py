"""What a project's blocks say: compact features, context counts, atomic answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.graph import control_depth
from tallyloom.operators.rubric import QUESTIONS
from tallyloom.sources.projects import Projects

# Names that say nothing, and names that say a certain thing.
PLAIN_TARGETS = ["sprite1", "sprite2", "sprite3", "stage"]
STATE_VARIABLES = ["score", "scores", "lives", "life", "timer", "time", "health", "hp"]
SCREENS = ["start", "end", "game over", "menu"]
PLAIN_BROADCASTS = ["message1", "message2", "message3", "message4", "message5", "broadcast", "event"]
LIST_UPDATES = ["data_addtolist", "data_deleteoflist", "data_deletealloflist", "data_insertatlist", "data_replaceitemoflist"]
LIST_ACCESSES = ["data_itemoflist", "data_itemnumoflist", "data_lengthoflist", "data_listcontainsitem"]



def starts(*prefixes: str) -> Column:
    """Whether the opcode has one of the prefixes."""
    out = F.col("opcode").startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | F.col("opcode").startswith(p)
    return out


def holds(column: str, *parts: str) -> Column:
    out = F.col(column).contains(parts[0])
    for p in parts[1:]:
        out = out | F.col(column).contains(p)
    return out


def _some(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


LOOP = ("control_repeat", "control_forever")
SEND, RECEIVE = "event_broadcast", "event_whenbroadcastreceived"
COSTUME = ("looks_switchcostumeto", "looks_nextcostume")


def _loud() -> Column:
    return starts("looks_") & holds("opcode", "say", "think", "change", "set")


def project_features(p: Projects) -> DataFrame:
    """One row per project: four counts and fifteen flags.

    Flags look at what a target owns as well as at opcodes; the answers of atomic_answers() mostly look at opcodes, and the two
    are meant to differ. A project without targets has zeros and false flags. One aggregation of blocks, one of
    targets, both partitioned by project.
    """
    blocks = p.blocks.groupBy("project_id").agg(
        F.count("*").alias("block_count"),
        _some(starts(*LOOP)).alias("loop"),
        _some(starts("control_if")).alias("conditional"),
        _some(starts("data_", "argument_")).alias("variable"),
        _some(starts("event_")).alias("event"),
        _some(starts("control_create_clone_of")).alias("clone"),
        _some(starts("sensing_touching")).alias("collision"),
        _some(starts(*COSTUME)).alias("animation"),
        _some(starts("sound_")).alias("sound"),
        _some(_loud()).alias("ui"),
        _some(starts("data_list")).alias("list"),
        _some(holds("opcode", "operator_", "math_", "data_changevariableby")).alias("math"),
        _some(starts(SEND)).alias("message"),
    )
    targets = p.targets.groupBy("project_id").agg(
        F.count_if(~F.col("is_stage")).alias("sprite_count"),
        F.sum("variables").alias("variable_count"),
        F.sum("lists").alias("list_count"),
        _some(F.col("sounds") > 0).alias("has_sounds"),
        _some(F.col("costumes") > 0).alias("has_costumes"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    variable = flag("variable") | (F.coalesce("variable_count", F.lit(0)) > 0)
    block_count = F.coalesce("block_count", F.lit(0))
    return (
        p.projects.select("project_id")
        .join(targets, "project_id", "left")
        .join(blocks, "project_id", "left")
        .select(
            "project_id",
            *(zero(c) for c in ("sprite_count", "block_count", "variable_count", "list_count")),
            flag("loop").alias("uses_loops"),
            flag("conditional").alias("uses_conditionals"),
            variable.alias("uses_variables"),
            flag("event").alias("uses_event_handling"),
            flag("clone").alias("uses_cloning"),
            flag("collision").alias("uses_collision"),
            (flag("animation") | flag("has_costumes")).alias("uses_animation"),
            (flag("sound") | flag("has_sounds")).alias("uses_sound"),
            flag("ui").alias("uses_ui_feedback"),
            (flag("list") | (F.coalesce("list_count", F.lit(0)) > 0)).alias("uses_lists"),
            flag("math").alias("uses_math"),
            flag("message").alias("uses_messaging"),
            (block_count >= 5).alias("uses_algorithms"),
            (flag("loop") & flag("conditional")).alias("uses_nesting"),
            ((F.coalesce("sprite_count", F.lit(0)) > 0) & (block_count >= 3) & flag("event") & variable).alias("uses_integration"),
        )
    )


def project_context(p: Projects) -> DataFrame:
    """One row per project: every count and flag that the atomic questions ask about."""
    own = control_depth(p.blocks)
    counts = {
        "conditional_count": starts("control_if"),
        "if_else_count": starts("control_if_else"),
        "loop_count": starts(*LOOP),
        "procedure_definition_count": starts("procedures_definition"),
        "procedure_call_count": starts("procedures_call"),
        "costume_switch_count": starts(*COSTUME),
        "wait_count": starts("control_wait"),
        "operator_count": starts("operator_"),
        "broadcast_send_count": starts(SEND),
        "broadcast_receive_count": starts(RECEIVE),
        "nested_control_count": F.col("nested"),
    }
    moves = ("motion_gotoxy", "motion_glidesecstoxy", "motion_setx", "motion_sety")
    flags = {
        "has_event": starts("event_"),
        "has_other_event": starts("event_when") & (F.col("opcode") != "event_whenflagclicked"),
        "has_loop": starts(*LOOP),
        "has_conditional": starts("control_if"),
        "has_data": starts("data_", "argument_"),
        "has_broadcast": starts(SEND),
        "has_procedure": starts("procedures_"),
        "has_coordinate": starts(*moves, "motion_changexby", "motion_changeyby"),
        "has_absolute_move": F.col("opcode").isin(*moves),
        "has_relative_move": F.col("opcode").isin("motion_changexby", "motion_changeyby"),
        "has_edge_bounce": F.col("opcode") == "motion_ifonedgebounce",
        "has_clone": starts("control_create_clone_of"),
        "has_collision": starts("sensing_touching"),
        "has_sound": starts("sound_"),
        "has_ui_feedback": _loud(),
        "has_message": starts("looks_say", "looks_think"),
        "has_data_list": starts("data_list"),
        "has_operator": holds("opcode", "operator_", "math_"),
        "has_compound": F.col("opcode").isin("operator_and", "operator_or", "operator_not"),
        "has_list_update": F.col("opcode").isin(*LIST_UPDATES),
        "has_list_access": F.col("opcode").isin(*LIST_ACCESSES),
    }
    handler = starts("event_when")
    spoken = F.lower(F.trim("broadcast_name"))
    descriptive = (spoken != "") & ~spoken.isin(*PLAIN_BROADCASTS)
    different = {
        "event_type_count": F.when(handler, F.col("opcode")),
        "handler_count": F.when(handler, F.nullif("target_name", F.lit(""))),
        "broadcast_name_count": F.col("broadcast_name"),
        "descriptive_broadcast_count": F.when(descriptive, F.col("broadcast_name")),
    }
    # Distinct names are few, and come from few blocks: on their own rows they leave the counts to plain hash aggregation.
    rows = [F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in different.items()]
    distinct = (
        p.blocks.filter(handler | F.col("broadcast_name").isNotNull())
        .select("project_id", F.inline(F.array(*rows)))
        .filter("value is not null")
        .groupBy("project_id", "kind", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("project_id")
        .agg(*(F.count_if(F.col("kind") == k).alias(k) for k in different))
    )
    blocks = own.groupBy("project_id").agg(
        F.count("*").alias("block_count"),
        F.max("depth").alias("max_control_nesting_depth"),
        *(F.count_if(c).alias(k) for k, c in counts.items()),
        *(_some(c).alias(k) for k, c in flags.items()),
        _some(F.col("cyclic")).alias("cyclic"),
    )
    target = F.lower("target_name")
    targets = p.targets.groupBy("project_id").agg(
        F.count_if(~F.col("is_stage")).alias("sprite_count"),
        _some((target != "") & ~target.isin(*PLAIN_TARGETS)).alias("named_target"),
        _some((target != "") & F.lower("target_name").rlike("|".join(SCREENS))).alias("screen_target"),
    )
    name = F.lower("name")
    variable, listed = F.col("kind") == "variable", F.col("kind") == "list"
    plain = lambda *prefixes: F.expr(" or ".join(f"startswith(lower(name), '{x}')" for x in prefixes))
    names = p.names.groupBy("project_id").agg(
        F.count_if(variable).alias("variable_name_count"),
        F.count_if(listed).alias("list_name_count"),
        _some(variable & (name != "") & ~plain("var", "item", "list")).alias("named_variable"),
        _some(listed & (name != "") & ~plain("list", "item")).alias("named_list"),
        _some(variable & name.isin(*STATE_VARIABLES)).alias("state_variable"),
    )
    said = F.lower("text")
    comments = p.comments.groupBy("project_id").agg(
        F.count("*").alias("comment_count"),
        _some(said.contains("subproblem") | said.contains("component")).alias("comment_part"),
        _some(said.contains("debug")).alias("comment_debug"),
        _some(said.contains("fix")).alias("comment_fix"),
    )
    whole = p.projects.select("project_id")
    for part in (targets, blocks, distinct, names, comments):
        whole = whole.join(part, "project_id", "left")
    filled = whole.select(
        "project_id",
        *(
            F.coalesce(F.col(f.name), F.lit(False) if f.dataType.simpleString() == "boolean" else F.lit(0)).alias(f.name)
            for f in whole.schema
            if f.name != "project_id"
        ),
    )
    return filled.select(
        "*",
        (F.col("has_data") | (F.col("variable_name_count") > 0)).alias("has_variable"),
        (F.col("has_data_list") | (F.col("list_name_count") > 0)).alias("has_list"),
    )


def atomic_answers(context: DataFrame) -> DataFrame:
    """context's project_id with one struct of boolean answers for each dimension."""
    return context.select(
        "project_id",
        *(F.struct(*(F.expr(rule).alias(q) for q, rule in rules.items())).alias(d) for d, rules in QUESTIONS.items()),
    )


def atomic_answers_long(context: DataFrame) -> DataFrame:
    """(project_id, dimension, question, answer)."""
    rows = [
        F.struct(F.lit(d).alias("dimension"), F.lit(q).alias("question"), F.expr(rule).alias("answer"))
        for d, rules in QUESTIONS.items()
        for q, rule in rules.items()
    ]
    return context.select("project_id", F.inline(F.array(*rows)))


def clone_handlers(blocks: DataFrame, text_col: str | None = None) -> DataFrame:
    """(project_id, clone_create, clone_start): whether a block creates clones, or starts as one."""
    op, text = F.col("opcode"), F.lower(F.col(text_col)) if text_col else F.lit("")
    clone = op.contains("clone") | text.contains("clone")
    return blocks.groupBy("project_id").agg(
        _some(clone & (op.contains("create") | text.contains("create"))).alias("clone_create"),
        _some(clone & (op.contains("start_as_clone") | text.contains("start"))).alias("clone_start"),
    )


def initialised_variables(blocks: DataFrame, order_col: str, variable_col: str, first: int = 50, shown: int = 5) -> DataFrame:
    """(project_id, num_var_inited, var_names_sample): variables set in a project's first blocks; the sample is sorted."""
    w = F.row_number().over(Window.partitionBy("project_id").orderBy(order_col))
    op = F.lower("opcode")
    sets = op.contains("set") | op.contains("create_variable") | op.contains("init")
    return (
        blocks.withColumn("at", w)
        .filter(F.col("at") <= first)
        .groupBy("project_id")
        .agg(F.sort_array(F.collect_set(F.when(sets, F.nullif(variable_col, F.lit(""))))).alias("v"))
        .select("project_id", F.size("v").cast("long").alias("num_var_inited"), F.slice("v", 1, shown).alias("var_names_sample"))
    )


def json_depth(text: Column) -> Column:
    """How deep arrays and objects nest in a JSON text; 0 for no container.

    Strings are blanked first; then one walk over the brackets that are left counts what is open.
    """
    bare = F.regexp_replace(text, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.split(F.translate(F.regexp_replace(bare, r"[^\[\]{}]", ""), "{}", "[]"), "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def walk(held: Column, x: Column) -> Column:
        now = held["open"] + F.when(x == "[", 1).when(x == "]", -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(held["most"], now).alias("most"))

    return F.aggregate(brackets, start, walk, lambda held: held["most"])
