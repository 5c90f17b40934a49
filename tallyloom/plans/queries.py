"""The registered queries: every operator over its corpus, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import parse, prompt, provider
from tallyloom.operators import evaluate as ev
from tallyloom.operators import features as fe
from tallyloom.operators import retrieve as rt
from tallyloom.operators import scoring as sc
from tallyloom.operators.graph import control_depth
from tallyloom.plans import corpus, loocv
from tallyloom.plans.dims import CATEGORIES, DIMENSIONS, FEATURES
from tallyloom.sources import files, json_array
from tallyloom.sources.lineage import cut, shared_dir

P = "p_"
SCHEMA = '{"loops": "0-5", "math": "0-5"}'


def _cells(spark, sf):
    return ev.cube(ev.clamp_predictions(corpus.grade_facts(spark, sf)))


def eval_mae_by_dimension(spark, sf):
    return ev.mae_by_dimension(_cells(spark, sf)).select("dimension", F.round("mae", 6).alias("mae"))


def eval_accuracy(spark, sf):
    return ev.accuracy(_cells(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


def eval_kappa(spark, sf):
    return ev.kappa(_cells(spark, sf)).select(F.round("kappa", 6).alias("kappa"))


def eval_class_prf(spark, sf):
    return ev.class_metrics(_cells(spark, sf)).select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def eval_macro(spark, sf):
    out = ev.macro_metrics(_cells(spark, sf))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def eval_confusion(spark, sf):
    return ev.confusion(_cells(spark, sf))


def eval_sample_errors(spark, sf):
    return ev.sample_errors(ev.clamp_predictions(corpus.grade_facts(spark, sf)))


def pred_clamp(spark, sf):
    raw = corpus.grade_facts(spark, sf).select(
        "sample_id",
        "dimension",
        F.expr("case when sample_id % 5 = 0 then null when sample_id % 5 = 1 then 'n/a' else cast((sample_id * dim_idx) % 19 - 6 + 0.5 as string) end").alias("predicted"),
    )
    return raw.select("sample_id", "dimension", sc.clamp(F.col("predicted")).alias("predicted"))


def confusion_map(spark, sf):
    return ev.confusion_map(corpus.grade_facts(spark, sf))


def confusion_remap(spark, sf):
    facts = corpus.grade_facts(spark, sf)
    return ev.remap(facts, ev.confusion_map(facts)).select("sample_id", "dimension", "predicted")


def vote_majority(spark, sf):
    return ev.vote(corpus.pass_facts(spark, sf))


def vote_median(spark, sf):
    return ev.vote(corpus.pass_facts(spark, sf), "median")


def vote_mean(spark, sf):
    return ev.vote(corpus.pass_facts(spark, sf), "mean")


def vote_pass_means(spark, sf):
    return ev.pass_means(corpus.pass_facts(spark, sf)).withColumn("mean", F.round("mean", 6))


def label_ids(spark, sf):
    return ev.project_ids(corpus.label_sheet(spark, sf)).select("ID", "project_id")


def label_grades_long(spark, sf):
    return ev.label_grades(corpus.label_sheet(spark, sf))


def project_features(spark, sf):
    return fe.project_features(corpus.block_projects(spark, sf))


def project_context(spark, sf):
    return fe.project_context(corpus.block_projects(spark, sf)).drop("cyclic")


def nesting_depth(spark, sf):
    deep = control_depth(corpus.block_projects(spark, sf).blocks)
    return deep.groupBy("project_id").agg(F.max("depth").alias("depth"), F.count_if("nested").alias("nested"))


def atomic_answers_long(spark, sf):
    return fe.atomic_answers_long(fe.project_context(corpus.block_projects(spark, sf)))


def _answers(spark, sf):
    return fe.atomic_answers(fe.project_context(corpus.block_projects(spark, sf)))


def scores_all_dims(spark, sf):
    return sc.scores_long(_answers(spark, sf))


def score_distribution(spark, sf):
    return scores_all_dims(spark, sf).groupBy("dimension", "score").agg(F.count("*").alias("projects"))


def _predictions(features: DataFrame) -> DataFrame:
    """features with one prediction for each dimension, spread over 0 to 5."""
    return features.select("*", *(((F.col("project_id") * 7 + i * 3 + F.col("block_count")) % 6).cast("int").alias(P + d) for i, d in enumerate(DIMENSIONS, 1)))


def _long(df: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(d).alias("dimension"), F.col(P + d).cast("int").alias("predicted")) for d in DIMENSIONS]
    return df.select("project_id", F.inline(F.array(*rows)))


def calibrate_v1(spark, sf):
    return _long(sc.calibrate(_predictions(project_features(spark, sf)), "v1"))


def calibrate_v2(spark, sf):
    return _long(sc.calibrate(_predictions(project_features(spark, sf)), "v2"))


def hard_constraints(spark, sf):
    p = corpus.block_projects(spark, sf)
    both = fe.project_features(p).join(fe.atomic_answers(fe.project_context(p)), "project_id")
    return _long(sc.constrain(_predictions(both)))


def complexity_band(spark, sf):
    return project_features(spark, sf).select("project_id", F.round(sc.complexity_score(), 6).alias("complexity"), sc.complexity_band().alias("band"))


def _records(spark, sf):
    grade = lambda i: ((F.col("project_id") * 7 + i * 5) % 6).cast("int")
    return project_features(spark, sf).select(
        F.col("project_id").alias("pos"), F.col("project_id").alias("id"), *FEATURES, F.array(*(grade(i) for i in range(1, 21))).alias("grades")
    )


def _kept(spark, sf):
    """_records(), written once: retrieval reads them several times."""
    return cut(_records(spark, sf))


def _tests(records):
    """Every record whose id is divisible by 100 looks for examples among all."""
    return records.filter("id % 100 = 0")


def similarity_top8(spark, sf):
    r = _kept(spark, sf)
    return rt.most_similar(r, _tests(r), 8).select("test_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


def candidate_pool(spark, sf):
    r = _kept(spark, sf)
    return rt.candidates(r, _tests(r), 8).groupBy("test_id").agg(F.count("*").alias("candidates"), F.sum("id").alias("id_sum"))


def mmr_weights(spark, sf):
    r = _kept(spark, sf)
    w = rt.mmr_weights(rt.most_similar(r, _tests(r), 8, 8))
    return w.select("test_id", *(F.round(c, 6).alias(c) for c in ("similarity_weight", "diversity_weight")))


def first_k_examples(spark, sf):
    r = _kept(spark, sf)
    return rt.first_examples(r, _tests(r), 3).select("test_id", "rank", "id")


def mmr_pick_k2(spark, sf):
    r = _kept(spark, sf)
    return rt.mmr_examples(r, _tests(r), 2).select("test_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def mmr_pick(spark, sf):
    r = _kept(spark, sf)
    return rt.mmr_examples(r, _tests(r), 3).select("test_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def retrieval_blend(spark, sf):
    r = _kept(spark, sf)
    examples = rt.most_similar(r, _tests(r), 3)
    predictions = corpus.with_dimensions(_tests(r).select(F.col("pos").alias("test_pos"))).selectExpr("test_pos", "dimension", "(test_pos + dim_idx) % 6 as predicted")
    return rt.blend(predictions, examples, r, 0.4).select(F.col("test_pos").alias("test_id"), "dimension", "predicted")


def balanced_pick(spark, sf):
    return rt.balanced_examples(_grade_records(spark, sf), 15).select("id")


def contrastive_pick(spark, sf):
    return rt.contrastive_examples(_grade_records(spark, sf), "loops", 6).select("id")


def _grade_records(spark, sf):
    c = corpus.table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("id"), F.array(*(((F.col("c_custkey") * (i + 6) + i * i) % 6).cast("int") for i in range(1, 21))).alias("grades")
    )


def response_grades(spark, sf):
    return parse.grades(corpus.responses(spark, sf), "conv_id", "turn")


def response_sanitized(spark, sf):
    r = corpus.responses(spark, sf).select("conv_id", "turn", parse.sanitize(F.col("response")).alias("s"))
    return r.select("conv_id", "turn", "s.error", "s.json", F.get_json_object("s.json", "$.loops").alias("loops"))


def response_confidence(spark, sf):
    scored = F.concat(F.lit('{"'), F.element_at(F.array(*map(F.lit, ("confidence", "loops", "error", "prob"))), (F.col("turn") % 4 + 1).cast("int")), F.lit('": 0.'), (F.col("conv_id") % 10), F.lit("}"))
    return corpus.responses(spark, sf).select("conv_id", "turn", parse.confidence(scored).alias("confidence"))


def _prompted(spark, sf, build):
    r = _kept(spark, sf)
    tests = _tests(r)
    own = F.struct(*FEATURES).alias("features")
    nearest = rt.most_similar(r, tests, 2).select("test_pos", "rank", "pos")
    examples = (
        nearest.join(r.select("pos", own, "grades"), "pos")
        .groupBy("test_pos")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "features", "grades"))), lambda x: F.struct(x["features"].alias("features"), x["grades"].alias("grades"))).alias("examples"))
    )
    return tests.select(F.col("pos").alias("test_pos"), "id", own).join(examples, "test_pos").select(F.col("id").alias("test_id"), build(F.col("features"), F.col("examples")).alias("prompt"))


def prompt_few_shot(spark, sf):
    return _prompted(spark, sf, prompt.few_shot)


def prompt_chain_of_thought(spark, sf):
    return _prompted(spark, sf, prompt.chain_of_thought)


def prompt_hybrid(spark, sf):
    return _prompted(spark, sf, prompt.hybrid)


def prompt_rubric_reference(spark, sf):
    return _prompted(spark, sf, prompt.guided)


def prompt_question_based(spark, sf):
    return _prompted(spark, sf, prompt.questioned)


def prompt_category(spark, sf):
    def build(features, examples):
        return F.array(*(F.struct(F.lit(c).alias("category"), prompt.category(features, examples, c).alias("prompt")) for c in CATEGORIES))

    return _prompted(spark, sf, build).select("test_id", F.inline("prompt"))


def prompt_generic(spark, sf):
    return _prompted(spark, sf, lambda features, examples: prompt.generic(examples, SCHEMA, ["algorithms", "nothing", "integration"]))


def prompt_ensemble(spark, sf):
    def build(features, examples):
        facts = F.array(F.concat(F.lit("Fact: blocks "), features["block_count"].cast("string")), F.lit("Fact: graded by hand"))
        return prompt.ensemble(prompt.example_texts(examples), SCHEMA, facts, ["sequencing"], 3)

    return _prompted(spark, sf, build).select("test_id", F.posexplode("prompt").alias("number", "prompt"))


def prompt_of_records(spark, sf):
    """The first three records are the examples, the fourth is the target."""
    return prompt.of_records(_records(spark, sf), 3, "hybrid")


def provider_grades(spark, sf):
    """Prompts, answers of the provider without a model, and the grades in them."""
    answers = provider.answer(prompt_few_shot(spark, sf))
    return parse.grades(answers, "test_id")


def response_server(spark, sf):
    r = corpus.responses(spark, sf).select("conv_id", "turn", parse.server_answer(F.col("response")).alias("a"))
    return r.select("conv_id", "turn", *(F.get_json_object("a", f"$.{k}").alias(k) for k in ("loops", "math", "lists", "raw_response")))


def _enriched(spark, sf):
    return loocv.enrich(corpus.project_sheet(spark, sf), corpus.raw_projects(spark, sf))


def enriched_records(spark, sf):
    """One row per row of the label sheet whose project is there: place, grades, features, scores."""
    r = _enriched(spark, sf)
    whole = lambda *c: F.concat_ws(",", *(x.cast("string") for x in c))
    return r.select(
        "pos", "id", F.array_join(F.col("grades").cast("array<string>"), ",").alias("grades"), *FEATURES, whole(*(F.col(f"model_scores.{d}") for d in DIMENSIONS)).alias("scores")
    )


def stored_evaluation(spark, sf):
    """Every pooled metric of the enriched records' stored scores."""
    return ev.summary_long(ev.summary(loocv.stored_facts(_enriched(spark, sf)))).withColumn("value", F.round("value", 6))


def leave_one_out(spark, sf):
    """Each record graded with the first two others as its examples, by the provider without a model; capped as in v1."""
    return loocv.leave_one_out(_records(spark, sf), loocv.Settings(num_examples=2, calibration="v1"))


def leave_one_out_summary(spark, sf):
    facts = cut(leave_one_out(spark, sf))  # read for every metric
    return ev.summary_long(ev.summary(facts)).withColumn("value", F.round("value", 6))


def leave_one_out_batched(spark, sf):
    """As leave_one_out, with MMR's two examples and one prompt for each category of dimensions."""
    return loocv.leave_one_out(_records(spark, sf), loocv.Settings(num_examples=2, style="hybrid", batched=True, calibration="v1"))


def leave_one_out_blended(spark, sf):
    """The first 200 records in the hybrid style, pulled toward their examples' grades."""
    return loocv.leave_one_out(_records(spark, sf), loocv.Settings(num_examples=2, style="hybrid", blend_weight=0.4, limit=200))


def clone_handlers(spark, sf):
    return fe.clone_handlers(corpus.block_rows(spark, sf))


def initialised_variables(spark, sf):
    rows = corpus.block_rows(spark, sf).withColumn(
        "variable", F.expr("case when opcode = 'data_setvariableto' then case k % 4 when 0 then 'score' when 1 then concat('var', k) when 2 then 'lives' else 'speed' end end")
    )
    found = fe.initialised_variables(rows, "block_id", "variable", first=20)
    return found.select("project_id", "num_var_inited", F.array_join("var_names_sample", ",").alias("sample"))


def json_depths(spark, sf):
    return corpus.raw_projects(spark, sf).select("project_id", fe.json_depth(F.col("json")).alias("depth"))


def _folder(spark, name):
    """A new folder in the shared one; what is returned reads it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sheet_round_trip(spark, sf):
    """The label sheet written as CSV and read back."""
    path = _folder(spark, "sheet")
    corpus.label_sheet(spark, sf).write.csv(path, header=True)
    return ev.label_grades(files.read_sheet(spark, path))


def map_round_trip(spark, sf):
    """The confusion map saved and loaded."""
    path = _folder(spark, "map")
    files.save_map(ev.confusion_map(corpus.grade_facts(spark, sf)), path)
    return files.load_map(spark, path)


def dataset_round_trip(spark, sf):
    """Records written as JSON arrays and scanned again."""
    path = _folder(spark, "dataset")
    rows = corpus.table(spark, sf, "customer").selectExpr(
        "c_custkey as id", "c_custkey % 7 / 4D as x", "concat('say \"{', c_custkey % 5, '}]', chr(92)) as t", "array(c_custkey % 3, 2L) as g"
    )
    json_array.write_array(rows, path, files=4)
    return json_array.read_records(spark, path, "id long, x double, t string, g array<long>")


def predictions_round_trip(spark, sf):
    """Remapped predictions written as JSON lines and read back."""
    path = _folder(spark, "predictions")
    files.write_predictions(confusion_remap(spark, sf), path)
    return files.read_dataset(spark, path, "sample_id long, dimension string, predicted int")


QUERIES = {
    f.__name__: f
    for f in (
        eval_mae_by_dimension, eval_accuracy, eval_kappa, eval_class_prf, eval_macro, eval_confusion, eval_sample_errors,
        pred_clamp, confusion_map, confusion_remap, vote_majority, vote_median, vote_mean, vote_pass_means, label_ids, label_grades_long,
        project_features, project_context, nesting_depth, atomic_answers_long, scores_all_dims, score_distribution,
        calibrate_v1, calibrate_v2, hard_constraints, complexity_band,
        similarity_top8, candidate_pool, mmr_weights, first_k_examples, mmr_pick_k2, mmr_pick, retrieval_blend, balanced_pick, contrastive_pick,
        response_grades, response_sanitized, response_confidence, response_server,
        prompt_few_shot, prompt_chain_of_thought, prompt_hybrid, prompt_rubric_reference, prompt_question_based, prompt_category,
        prompt_generic, prompt_ensemble, prompt_of_records, provider_grades,
        enriched_records, stored_evaluation, leave_one_out, leave_one_out_summary, leave_one_out_batched, leave_one_out_blended,
        clone_handlers, initialised_variables, json_depths, sheet_round_trip, map_round_trip, dataset_round_trip, predictions_round_trip,
    )
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_distribution(spark, sf_dir)
