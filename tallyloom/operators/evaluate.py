"""Evaluation of ordinal predictions, from long facts (sample_id, dimension, actual, predicted).

Every metric but the per-sample ones comes from one cube of (dimension, actual, predicted) counts, whose size does not depend on
the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.dims import DIMENSIONS

CLASSES = range(6)


def clamp_predictions(facts: DataFrame) -> DataFrame:
    """facts with predicted as a whole number from 0 to 5; missing and unreadable values are 0, missing actual ones too."""
    from tallyloom.operators.scoring import clamp

    return facts.withColumns({"predicted": clamp(F.col("predicted")), "actual": F.coalesce(F.col("actual").cast("int"), F.lit(0))})


def cube(facts: DataFrame) -> DataFrame:
    """(dimension, actual, predicted, n)."""
    return facts.groupBy("dimension", "actual", "predicted").agg(F.count("*").alias("n"))


def mae_by_dimension(cells: DataFrame) -> DataFrame:
    error = F.abs(F.col("actual") - F.col("predicted"))
    return cells.groupBy("dimension").agg((F.sum(error * F.col("n")) / F.sum("n")).alias("mae"))


def accuracy(cells: DataFrame) -> DataFrame:
    """One row: the share of exact matches in percent. All samples have all dimensions, so it is the mean over samples too."""
    return cells.agg((100 * F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def kappa(cells: DataFrame) -> DataFrame:
    """One row: Cohen's kappa over all cells; 0 without any, 1 or 0 where only one category occurs or chance alone explains all."""
    sides = cells.select("n", F.explode(F.array(F.struct(F.lit(True).alias("is_actual"), F.col("actual").alias("c")), F.struct(F.lit(False).alias("is_actual"), F.col("predicted").alias("c")))).alias("s"))
    shares = sides.groupBy("s.c").agg(
        F.sum(F.when(F.col("s.is_actual"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("s.is_actual"), 0).otherwise(F.col("n"))).alias("p")
    )
    expected = shares.agg(F.sum(F.col("a").cast("double") * F.col("p")).alias("products"), F.count("*").alias("categories"))
    totals = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    o, e = F.col("hits") / F.col("n"), F.col("products") / (F.col("n").cast("double") * F.col("n"))
    plain = F.when(F.col("hits") == F.col("n"), 1.0).otherwise(0.0)
    return totals.crossJoin(F.broadcast(expected)).select(  # one row by one row
        F.when(F.col("n").isNull(), 0.0).when((F.col("categories") <= 1) | (e == 1), plain).otherwise((o - e) / (1 - e)).alias("kappa")
    )


def class_metrics(cells: DataFrame) -> DataFrame:
    """(class, precision, recall, f1) for classes 0 to 5; 0 where there is nothing to divide by."""
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    columns = []
    for k in CLASSES:
        a, p = F.col("actual") == k, F.col("predicted") == k
        columns += [count(a & p).alias(f"tp{k}"), count(p).alias(f"p{k}"), count(a).alias(f"a{k}")]
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    rows = [
        F.struct(F.lit(k).alias("class"), ratio(F.col(f"tp{k}"), F.col(f"p{k}")).alias("precision"), ratio(F.col(f"tp{k}"), F.col(f"a{k}")).alias("recall"))
        for k in CLASSES
    ]
    both = F.col("precision") + F.col("recall")
    return (
        cells.agg(*columns)
        .select(F.inline(F.array(*rows)))
        .withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    )


def macro_metrics(cells: DataFrame) -> DataFrame:
    """One row: means over all six classes, present or not."""
    return class_metrics(cells).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def confusion(cells: DataFrame) -> DataFrame:
    """(dimension, cell, n), a cell reading actual_A->pred_P; only what occurs."""
    return cells.select("dimension", F.format_string("actual_%d->pred_%d", F.col("actual").cast("int"), F.col("predicted").cast("int")).alias("cell"), "n")


def sample_errors(facts: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """One row per sample: exact_match_percent and the absolute error of each dimension."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    hit = F.col("actual") == F.col("predicted")
    return facts.groupBy("sample_id").agg(
        (100 * F.count_if(hit) / F.lit(len(dimensions))).alias("exact_match_percent"),
        *(F.max(F.when(F.col("dimension") == d, error)).alias(d) for d in dimensions),
    )


def summary(facts: DataFrame) -> DataFrame:
    """One row with every pooled metric; raises on empty facts. Samples are told apart by pos, where facts have it, else by sample_id."""
    cells = cube(clamp_predictions(facts))
    if cells.isEmpty():
        raise ValueError("there is nothing to evaluate")
    one = facts.agg(F.count_distinct("pos" if "pos" in facts.columns else "sample_id").alias("num_samples"), F.count_distinct("dimension").alias("num_dimensions"))
    by = mae_by_dimension(cells).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "mae")))).alias("mae_by_dimension"))
    classes = class_metrics(cells).agg(
        *(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", c)))).alias(f"{c}_by_class") for c in ("precision", "recall", "f1"))
    )
    for part in (by, accuracy(cells), kappa(cells), classes, macro_metrics(cells)):
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one


def summary_long(one: DataFrame) -> DataFrame:
    """(metric, key, value) of summary()'s row: key is a dimension, a class or null."""
    plain = ["num_samples", "num_dimensions", "accuracy", "kappa", "macro_precision", "macro_recall", "macro_f1"]
    keyed = ["mae_by_dimension", "precision_by_class", "recall_by_class", "f1_by_class"]

    def entry(metric: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    def entries(metric: str) -> Column:
        return F.transform(F.map_entries(metric), lambda x: entry(metric, x["key"], x["value"]))

    rows = [F.array(entry(c, F.lit(None), F.col(c))) for c in plain] + [entries(c) for c in keyed]
    return one.select(F.explode(F.concat(*rows)).alias("e")).select("e.*")


def confusion_map(facts: DataFrame, order_col: str = "sample_id") -> DataFrame:
    """(dimension, predicted, remapped): the most frequent actual value; of equally frequent ones, the one first met in order_col."""
    pairs = facts.groupBy("dimension", "predicted", "actual").agg(F.count("*").alias("n"), F.min(order_col).alias("first"))
    return pairs.groupBy("dimension", "predicted").agg(F.max_by("actual", F.struct("n", -F.col("first"), -F.col("actual"))).alias("remapped"))


def remap(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """facts with predicted replaced where mapping knows its dimension and value, null ones included."""
    m = mapping.select(F.col("dimension").alias("_d"), F.col("predicted").alias("_p"), "remapped")
    on = (facts["dimension"] == m["_d"]) & facts["predicted"].eqNullSafe(m["_p"])
    return facts.join(m, on, "left").withColumn("predicted", F.coalesce("remapped", "predicted")).drop("_d", "_p", "remapped")


def vote(passes: DataFrame, how: str = "vote") -> DataFrame:
    """(sample_id, dimension, predicted) of (sample_id, dimension, pass, predicted).

    vote: the most frequent value; of several, the one nearest the mean, then the smaller. median and mean round half to even.
    """
    key = ["sample_id", "dimension"]
    if how in ("median", "mean"):
        return passes.groupBy(*key).agg(F.rint(getattr(F, how)("predicted")).cast("long").alias("predicted"))
    counts = passes.groupBy(*key, "predicted").agg(F.count("*").alias("n"))
    total = F.sum(F.col("predicted") * F.col("n")) / F.sum("n")
    return (
        counts.groupBy(*key)
        .agg(F.max("n").alias("most"), total.alias("mean"), F.collect_list(F.struct("n", "predicted")).alias("v"))
        .select(
            *key,
            F.array_min(
                F.transform(F.filter("v", lambda x: x["n"] == F.col("most")), lambda x: F.struct(F.abs(x["predicted"] - F.col("mean")).alias("far"), x["predicted"].alias("predicted")))
            )["predicted"].alias("predicted"),
        )
    )


def pass_means(passes: DataFrame) -> DataFrame:
    """(sample_id, dimension, mean, rounded)."""
    return passes.groupBy("sample_id", "dimension").agg(F.avg("predicted").alias("mean"), F.rint(F.avg("predicted")).cast("long").alias("rounded"))


def project_ids(sheet: DataFrame) -> DataFrame:
    """sheet with project_id: the number in URL's /projects/ part, else ID; rows without either go."""
    of_url = F.try_to_number(F.nullif(F.regexp_extract("URL", r"/projects/(\d+)", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    return sheet.withColumn("project_id", F.coalesce(of_url, F.col("ID").cast("long"))).filter("project_id is not null")


def sheet_grades(sheet: DataFrame) -> dict[str, Column]:
    """For each dimension, its grade in a sheet with one column per dimension; blank, unreadable and missing grades are 0."""
    from tallyloom.plans.dims import SHEET_COLUMNS

    there = {c.lower() for c in sheet.columns}
    grade = lambda c: F.coalesce(F.expr(f"cast(try_cast(`{c}` as double) as int)"), F.lit(0)) if c.lower() in there else F.lit(0)
    return {d: grade(c) for c, d in SHEET_COLUMNS.items()}


def label_grades(sheet: DataFrame) -> DataFrame:
    """(project_id, dimension, actual) of a sheet; see sheet_grades()."""
    wide = project_ids(sheet)
    grades = sheet_grades(sheet)
    return wide.select("project_id", *(g.alias(d) for d, g in grades.items())).unpivot("project_id", list(grades), "dimension", "actual")
