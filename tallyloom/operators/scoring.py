"""From answers to scores: rule ladders, evidence caps, hard constraints, complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.rubric import LADDERS, QUESTIONS
from tallyloom.plans.dims import DIMENSIONS, FLAG_FEATURES


def true_count(dimension: str) -> Column:
    return sum((F.col(f"{dimension}.{q}").cast("int") for q in QUESTIONS[dimension]), F.lit(0))


def score(dimension: str, n: Column | None = None) -> Column:
    """The ladder's score of a dimension's struct of answers; a null struct scores 1. n: its true_count(), where it has been taken."""
    n, total = true_count(dimension) if n is None else n, len(QUESTIONS[dimension])
    if dimension in LADDERS:
        out = F.lit(None).cast("int")
        for condition, value in reversed(LADDERS[dimension]):
            out = F.when(_rule(dimension, condition, n), value).otherwise(out)
    else:  # shares of a fifth, two fifths and three fifths, in whole numbers
        out = F.when(n == 0, 1).when(5 * n <= total, 2).when(5 * n <= 2 * total, 3).when(5 * n <= 3 * total, 4).otherwise(5)
    return F.when(F.col(dimension).isNull(), 1).otherwise(out)


def _rule(dimension: str, condition: str, n: Column) -> Column:
    if condition.startswith("n "):
        _, sign, value = condition.split()
        return n == int(value) if sign == "=" else n >= int(value)
    if condition.endswith(" and n = 6"):
        return _rule(dimension, condition.removesuffix(" and n = 6"), n) & (n == 6)
    for q in QUESTIONS[dimension]:
        condition = " ".join(f"{dimension}.{w}" if w.strip("()") == q else w for w in condition.split(" "))
        condition = condition.replace(f"{dimension}.({q}", f"({dimension}.{q}")
    return F.expr(condition)


def scores(answers: DataFrame) -> DataFrame:
    """(project_id, one score column for each dimension)."""
    counted = answers.select("project_id", *DIMENSIONS, *(true_count(d).alias(f"n_{d}") for d in DIMENSIONS))  # once, not in every branch
    return counted.select("project_id", *(score(d, F.col(f"n_{d}")).alias(d) for d in DIMENSIONS))


def scores_long(answers: DataFrame) -> DataFrame:
    """(project_id, dimension, score). An unpivot: inline() over rules on structs loses its rows to column pruning."""
    return scores(answers).unpivot("project_id", DIMENSIONS, "dimension", "score")


def complexity_score() -> Column:
    """Over the columns of project_features(); missing numbers count as 0 and missing flags as false."""
    number = lambda c: F.coalesce(c, F.lit(0))
    flags = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in FLAG_FEATURES), F.lit(0))
    return (
        number("sprite_count") * 1.2 + number("block_count") / 25.0 + number("variable_count") * 1.5 + number("list_count") * 2.0 + flags * 2.2
    )


def complexity_band() -> Column:
    s = complexity_score()
    return F.when(s < 28, 0).when(s < 52, 1).otherwise(2)


#: (first mode, condition, dimension, cap). A cap holds only for predictions below 4.
CAPS = [
    ("v1", "not uses_event_handling", "event_handling", 2),
    ("v1", "not uses_messaging", "messaging", 2),
    ("v1", "not uses_nesting", "nesting", 2),
    ("v1", "not uses_lists", "lists", 2),
    ("v1", "not uses_sound", "sound", 2),
    ("v1", "not uses_collision", "collision", 2),
    ("v1", "block_count < 80", "algorithms", 3),
    ("v1", "block_count < 80", "conditionals", 3),
    ("v1", "block_count < 80", "loops", 3),
    ("v2", "not uses_animation", "animation", 2),
    ("v2", "not uses_math", "math", 2),
    ("v2", "not uses_algorithms", "algorithms", 2),
    ("v2", "not uses_variables", "variables", 2),
    ("v2", "sprite_count <= 1", "problem_decomposition", 3),
    ("v2", "sprite_count <= 1", "integration", 2),
    ("v2", "sprite_count <= 1", "messaging", 1),
    ("v2", "block_count < 45", "sequencing", 3),
    ("v2", "block_count < 45", "coordinates", 3),
    ("v2", "block_count < 45", "procedures", 2),
    ("v2", "block_count < 45", "nesting", 1),
    ("v2", "block_count < 25", "loops", 2),
    ("v2", "block_count < 25", "conditionals", 2),
    ("v2", "block_count < 25", "algorithms", 2),
]


def clamp(value: Column) -> Column:
    """A prediction as a whole number from 0 to 5: truncated, 0 where missing or not a number."""
    number = value.try_cast("double")
    held = F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(-9.0), F.least(F.lit(9.0), number))).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(held, F.lit(0))))  # least() would pass over a null


def calibrate(df: DataFrame, mode: str = "v1", prefix: str = "p_") -> DataFrame:
    """df with its prediction columns capped where the evidence for more is missing.

    Any mode but "", "off", "none" and "v2" is v1. Missing flags count as false and missing numbers as 0.
    """
    if mode in ("", "off", "none"):
        return df
    flag = {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in FLAG_FEATURES}
    number = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("block_count", "sprite_count")}

    def holds(condition: str) -> Column:
        words = condition.split()
        if words[0] == "not":
            return ~flag[words[1]]
        return number[words[0]] < int(words[2]) if words[1] == "<" else number[words[0]] <= int(words[2])

    out = {}
    for d in DIMENSIONS:
        p = F.coalesce(F.col(prefix + d), F.lit(0))
        caps = [F.when(holds(c), cap) for m, c, dim, cap in CAPS if dim == d and (m == "v1" or mode == "v2")]
        out[prefix + d] = clamp(F.when(p < 4, F.least(p, *caps)).otherwise(p) if caps else p)
    return df.withColumns(out)


def constrain(df: DataFrame, prefix: str = "p_", depth_col: str | None = None) -> DataFrame:
    """df with its prediction columns after the hard constraints, in their order; later ones see what earlier ones did.

    df has the features, one struct of answers for each dimension and the predictions. A null prediction is absent and
    stays null; answers must be there (without them, most rules would pull everything down).
    """
    feature = lambda c: F.coalesce(F.col(c), F.lit(False))
    answer = lambda d, q: F.coalesce(F.col(f"{d}.{q}"), F.lit(False))
    blocks = F.coalesce("block_count", F.lit(0))
    p = lambda d: F.col(prefix + d)
    whole = lambda d: F.rint(p(d))
    inferred = F.when(answer("nesting", "nested_systems_used"), 4).when(
        answer("nesting", "loops_nested") | answer("nesting", "conditionals_nested"), 2
    ).otherwise(0)
    depth = F.coalesce(F.col(depth_col).cast("int"), inferred) if depth_col else inferred
    event = feature("uses_event_handling") | answer("sequencing", "clear_start_to_finish_flow") | answer("event_handling", "events_beyond_green_flag")
    flow = answer("sequencing", "clear_start_to_finish_flow")
    costume, smooth, tied = (answer("animation", q) for q in ("costume_changes_used", "animations_loop_smoothly", "animations_tied_to_game_events"))
    step, works, efficient, edge = (
        answer("algorithms", q) for q in ("step_by_step_strategy", "algorithm_works_for_inputs", "efficiency_considered", "edge_cases_handled")
    )
    support = lambda d: F.coalesce(true_count(d), F.lit(0))

    def put(df: DataFrame, **changes: Column) -> DataFrame:
        return df.withColumns({prefix + d: F.when(p(d).isNotNull(), c).cast("double") for d, c in changes.items()})

    df = df.withColumns({prefix + d: p(d).cast("double") for d in DIMENSIONS})
    df = put(  # what isn't there at all
        df,
        cloning=F.when(feature("uses_cloning") | answer("cloning", "clones_created"), p("cloning")).otherwise(0),
        animation=F.when(feature("uses_animation") | costume, p("animation")).otherwise(0),
        event_handling=F.when(event, p("event_handling")).otherwise(0),
        variables=F.when(feature("uses_variables") | answer("variables", "variables_used"), p("variables")).otherwise(1),
        integration=F.when(feature("uses_integration") | (support("integration") > 0), p("integration")).otherwise(0),
    )
    small = lambda d: F.when(blocks < 3, F.least(F.floor(p(d)), F.lit(1))).when((blocks < 7) & (whole(d) == 5), 4).otherwise(p(d))
    df = put(df, algorithms=small("algorithms"), sequencing=small("sequencing"))
    s = whole("sequencing")
    df = put(
        df,
        sequencing=F.when((s >= 4) & ~(answer("sequencing", "logical_order") | flow), 3).when((s == 1) & (event | flow), 2).otherwise(p("sequencing")),
    )
    s = whole("problem_decomposition")
    bare = ~(answer("problem_decomposition", "has_hierarchy") & answer("problem_decomposition", "dependencies_explicit"))
    df = put(
        df,
        problem_decomposition=F.when(~answer("problem_decomposition", "has_subproblems"), F.least(s, F.lit(2)))
        .when((s >= 4) & bare, F.greatest(F.lit(3), F.least(s, F.lit(4))))
        .otherwise(p("problem_decomposition")),
    )
    s = whole("nesting")
    limited = F.when(depth <= 1, F.least(s, F.lit(1))).when(depth == 2, F.least(s, F.lit(3))).otherwise(p("nesting"))
    df = put(df, nesting=F.when((s >= 4) & ~answer("nesting", "nesting_serves_clear_purpose"), F.least(limited, F.lit(3))).otherwise(limited))
    s = whole("animation")
    df = put(
        df,
        animation=F.when(~costume, 0).when((s == 5) & ~(smooth & tied), 4).when((s == 4) & ~(smooth | tied), 3).otherwise(p("animation")),
    )
    s, supports = whole("algorithms"), sum((x.cast("int") for x in (step, works, efficient, edge)), F.lit(0))
    a = F.when((blocks < 10) & (s >= 5), 4).otherwise(p("algorithms"))
    a = F.when((s >= 4) & (supports < 3), F.greatest(F.lit(3), F.least(a, F.lit(4)))).otherwise(a)
    df = put(df, algorithms=F.when(~step & (s >= 3), F.least(a, F.lit(2))).otherwise(a))
    df = put(
        df,
        **{
            d: F.when((whole(d) == 5) & (support(d) == 2), 4).when((whole(d) == 5) & (support(d) < 2), 3).otherwise(p(d))
            for d in ("algorithms", "animation", "sequencing", "problem_decomposition", "nesting")
        },
    )
    return df.withColumns({prefix + d: F.when(p(d).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(5), whole(d).cast("int")))) for d in DIMENSIONS})
