"""Files in and out: sheets, datasets, stage outputs, prompts, predictions, confusion maps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.plans.dims import SHEET_COLUMNS
from tallyloom.sources.json_array import read_records
from tallyloom.sources.publish import publish, published


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A label sheet from CSV or Parquet: ID long, URL, Reviewer and the dimensions' columns as text."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.csv(path, header=True)
    wanted = {"ID": "long", "URL": "string", "Reviewer": "string"} | dict.fromkeys(SHEET_COLUMNS, "string")
    return raw.select(*((F.col(f"`{c}`").try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()))


def read_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Arrays of records in JSON files, each read by many tasks, or Parquet."""
    return spark.read.parquet(path) if path.endswith(".parquet") else read_records(spark, path, schema)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_stages(raw: DataFrame, answers: DataFrame, scores: DataFrame, folder: str, order: str | None = None) -> dict[str, str]:
    """Raw projects, answers and scores as one set of publish(), one row per project; where a project occurs again, the last one stays.

    The last by order, where the table has such a column, else in the order in which it is read. Returns the tables' paths.
    """
    paths = {"raw_projects": raw, "atomic_features": answers, "model_scores": scores}
    last = {}
    for name, df in paths.items():
        by = order if order and order in df.columns else "_read"
        last[name] = last_of_each(df if by == order else df.withColumn(by, F.monotonically_increasing_id()), "project_id", by).drop("_read")
    return {f"{name}_path": path for name, path in publish(last, folder).items()}


def write_results(records: DataFrame, summary: DataFrame, folder: str) -> dict[str, str]:
    """Enriched records that have features, and their summary, as one set of publish(). Returns the tables' paths."""
    return publish({"records": records.filter(F.col("block_count").isNotNull()), "summary": summary.coalesce(1)}, folder)


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(published(spark, folder)[name])


def write_dataset(records: DataFrame, path: str) -> None:
    """Enriched records that have features."""
    records.filter(F.col("block_count").isNotNull()).write.mode("overwrite").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_prompts(prompts: DataFrame, path: str, prompt_col: str = "prompt") -> None:
    """Prompts as text; what was there before goes."""
    prompts.select(F.col(prompt_col).alias("value")).write.mode("overwrite").text(path, lineSep="\n\n\n")


def write_prompt(prompt: str, path: str) -> str:
    """One prompt as one text file on the driver, over whatever was there."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(prompt)
    return path


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def append_log(responses: DataFrame, path: str) -> None:
    """Raw responses with the time of writing, after those that are there."""
    responses.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


MAP_SCHEMA = "dimension string, predicted long, remapped long"


def save_map(mapping: DataFrame, path: str) -> None:
    mapping.select("dimension", F.col("predicted").cast("long"), F.col("remapped").cast("long")).write.mode("overwrite").parquet(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """A saved confusion map; an empty one where there is none."""
    try:
        return spark.read.schema(MAP_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MAP_SCHEMA)
