"""What is asked of others over the network, asked once: answers go to a table as they come, and a later run asks for the rest."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.sources.lineage import cut

#: Questions that go out between two commits of the store.
WAVE_ROWS = 100_000


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def best(answers: DataFrame, key: str) -> DataFrame:
    """One row for each key: one without an error, if there is any; of several, the least."""
    rest = [c for c in answers.columns if c not in (key, "error")]
    w = Window.partitionBy(key).orderBy(F.col("error").asc_nulls_first(), *rest)
    return answers.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def fill(wanted: DataFrame, key: str, path: str, schema: str, ask: Callable[[DataFrame], DataFrame], wave_rows: int = WAVE_ROWS) -> DataFrame:
    """The stored answers of wanted's keys, after asking for those that are missing or failed before.

    ask makes a table of this schema, which has key and error (null for an answer), from rows of wanted, by narrow steps only: a wave of them is
    one job without a shuffle, so that a lost executor costs its unfinished tasks, and a failed run the wave it was in. Equal keys are asked once; null keys
    are not asked for.
    """
    spark = wanted.sparkSession
    had = stored(spark, path, schema).filter("error is null").select(key)
    todo = wanted.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(had, key, "left_anti")
    todo = cut(todo.withColumn("__wave", F.xxhash64(key)))
    waves = math.ceil(todo.count() / wave_rows)
    for wave in range(waves):
        some = todo.filter(F.pmod("__wave", F.lit(waves)) == wave).drop("__wave")
        ask(some).select(*had.sparkSession.createDataFrame([], schema).columns).write.mode("append").parquet(path)
    return best(stored(spark, path, schema).join(wanted.select(key).distinct(), key, "left_semi"), key)
