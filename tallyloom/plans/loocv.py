"""The three entry points as plans: enrichment, leave-one-out evaluation, evaluation of stored results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import parse, prompt, provider
from tallyloom.operators import evaluate, features, retrieve, scoring, similar
from tallyloom.plans.corpus import SPREAD_ROWS, with_dimensions
from tallyloom.plans.dims import CATEGORIES, DIMENSIONS, FEATURES
from tallyloom.sources.lineage import cut
from tallyloom.sources.projects import Projects, parse_projects


def enrich(sheet: DataFrame, raw: DataFrame) -> DataFrame:
    """Label rows with the features, answers and scores of their projects, one record for each row.

    raw is (project_id, json). Rows without a project id, or whose project's JSON is missing, null or `{}`, go; a project with no targets
    stays; of several texts of one project, the least counts. Returns pos (the order of the sheet's rows), id, grades (array in the order of DIMENSIONS), the features, answers and
    model_scores (structs). A project that can't be parsed counts as one without targets.
    """
    labelled = evaluate.project_ids(sheet.withColumn("_row", F.monotonically_increasing_id()))
    labelled = labelled.select("_row", "project_id", F.array(*evaluate.sheet_grades(sheet).values()).alias("grades"))
    there = raw.filter(F.col("json").isNotNull() & ~F.trim("json").isin("", "null", "{}")).groupBy("project_id").agg(F.min("json").alias("json"))
    projects = parse_projects(there)
    context = features.project_context(projects)
    answers = features.atomic_answers(context)
    scored = scoring.scores(answers).select("project_id", F.struct(*DIMENSIONS).alias("model_scores"))
    nested = answers.select("project_id", F.struct(*DIMENSIONS).alias("answers"))
    whole = features.project_features(projects).join(nested, "project_id").join(scored, "project_id")
    return with_positions(labelled.join(whole, "project_id").withColumnRenamed("project_id", "id"), "_row").drop("_row")


def with_positions(records: DataFrame, by: str = "id") -> DataFrame:
    """records with pos, their place by a column from 0, without gathering them in one task."""
    dealt = cut(records.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("_part").count()
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_part").withColumn("pos", F.col("_start") + F.col("_in")).drop("_at", "_part", "_in", "_start")


@dataclass(frozen=True)
class Settings:
    """How a leave-one-out run goes."""

    num_examples: int = 3
    style: str = "few_shot"
    batched: bool = False
    passes: int = 3
    aggregate: str = "vote"
    calibration: str = "off"
    blend_weight: float = 0.0
    limit: int = 0
    balanced: int = 0
    partitions: int | None = None
    window: int = 1
    retries: int = 2
    store: str | None = None
    make_provider: Callable[[], provider.Provider] = field(default=provider.fixed_answers)


def leave_one_out(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Long facts (sample_id, dimension, actual, predicted): each record graded with others as its examples.

    Needs two records and one example at least: with fewer, the record's own grades would be its example. Predictions are
    clamped, blended and calibrated in this order.
    """
    if settings.num_examples < 1:
        raise ValueError("a record needs at least one example that isn't itself")
    if settings.limit > 0:
        records = records.orderBy("pos").limit(settings.limit)
    if settings.balanced > 0:
        records = retrieve.balanced_examples(records, settings.balanced)
    records = cut(records)
    total = records.count()
    if total < 2:
        raise ValueError("leave-one-out needs two records at least")
    k = settings.num_examples
    own = F.struct(*FEATURES).alias("features")
    # Files of many like records are small, and what Spark takes for small goes through the driver: joins are told to merge.
    if settings.style == "hybrid" or settings.batched:
        chosen = cut(retrieve.mmr_held_out(records, k))
        shown = (
            chosen.join(records.select("pos", own, "grades").hint("merge"), "pos")
            .groupBy("test_pos")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "pos", "similarity", "features", "grades"))).alias("examples"))
        )
        asked = records.select(F.col("pos").alias("test_pos"), own).join(shown.hint("merge"), "test_pos")
    else:
        asked = retrieve.with_first_examples(records, k)
    if settings.blend_weight > 0:
        asked = cut(asked)
        examples = asked.select("test_pos", F.col("features").alias("a"), F.inline("examples")).withColumnRenamed("features", "b")
        examples = examples.withColumn("similarity", F.coalesce("similarity", similar.similarity())).drop("a", "b", "grades")
    asked = asked.withColumn("examples", F.transform("examples", lambda x: F.struct(x["features"].alias("features"), x["grades"].alias("grades"))))
    if settings.batched:
        each = [F.struct(F.lit(i).alias("part"), prompt.category(F.col("features"), F.col("examples"), c, settings.style).alias("prompt")) for i, c in enumerate(CATEGORIES)]
        prompts = asked.select("test_pos", F.inline(F.array(*each)))
    else:
        prompts = asked.select("test_pos", F.lit(0).alias("part"), prompt.STYLES[settings.style](F.col("features"), F.col("examples")).alias("prompt"))
    prompts = prompts.withColumn("pass", F.explode(F.array(*map(F.lit, range(settings.passes)))))
    how = {"partitions": settings.partitions, "window": settings.window, "retries": settings.retries}
    if settings.store:  # a later run asks only for what this one didn't get
        answers = provider.answer_stored(prompts, settings.make_provider, settings.store, by=("pass",), **how).drop("prompt")
    else:
        answers = cut(provider.answer(prompts, settings.make_provider, **how).drop("prompt"))
    # Answers are shorter than their grades as rows, and a few MB of them make many: tasks go by answers, not by bytes.
    asks = settings.passes * (len(CATEGORIES) if settings.batched else 1)
    read = parse.grades(answers.repartition(-(-total * asks // (3 * SPREAD_ROWS)), "test_pos"), "test_pos", "part", "pass")
    one = read.groupBy("test_pos", "pass", "dimension").agg(F.max_by("grade", "part").alias("predicted"))
    voted = evaluate.vote(one.withColumnRenamed("test_pos", "sample_id"), settings.aggregate).withColumnRenamed("sample_id", "test_pos")
    if settings.blend_weight > 0:
        grid = with_dimensions(records.select(F.col("pos").alias("test_pos"))).drop("dim_idx")
        whole = evaluate.clamp_predictions(grid.join(voted.hint("merge"), ["test_pos", "dimension"], "left").withColumn("actual", F.lit(0))).drop("actual")
        voted = retrieve.blend(whole, examples, records, settings.blend_weight)
    wide = voted.groupBy("test_pos").agg(*(F.max(F.when(F.col("dimension") == d, scoring.clamp(F.col("predicted")))).alias("_" + d) for d in DIMENSIONS))
    all_ = records.join(wide.hint("merge"), records["pos"] == wide["test_pos"], "left")  # no answer is a prediction of 0
    capped = scoring.calibrate(all_.withColumns({"p_" + d: F.coalesce("_" + d, F.lit(0)) for d in DIMENSIONS}), settings.calibration)
    rows = [
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.get("grades", F.lit(i)), F.lit(0)).alias("actual"), F.col("p_" + d).cast("int").alias("predicted"))
        for i, d in enumerate(DIMENSIONS)
    ]
    return capped.select(F.col("id").alias("sample_id"), F.inline(F.array(*rows)))


def stored_facts(records: DataFrame) -> DataFrame:
    """Long facts (pos, sample_id, dimension, actual, predicted) of records with grades and model_scores, as enrich() gives them."""
    flat = records.select("pos", F.col("id").alias("sample_id"), "grades", *(scoring.clamp(F.col(f"model_scores.{d}")).alias(d) for d in DIMENSIONS))
    place = F.array_position(F.array(*map(F.lit, DIMENSIONS)), F.col("dimension")).cast("int")
    long = flat.unpivot(["pos", "sample_id", "grades"], DIMENSIONS, "dimension", "predicted")
    return long.select("pos", "sample_id", "dimension", F.coalesce(F.get("grades", place - 1), F.lit(0)).alias("actual"), "predicted")


def features_of(raw: DataFrame) -> tuple[Projects, DataFrame]:
    projects = parse_projects(raw)
    return projects, features.project_features(projects)
