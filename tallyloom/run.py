"""Programs: read files, run a plan, write its results as one published set.

    python -m tallyloom.run enrich SHEET PROJECTS OUT      label sheet (CSV or Parquet) and raw projects -> records
    python -m tallyloom.run leave-one-out RECORDS OUT      records -> facts and summary, as the environment's settings say
    python -m tallyloom.run evaluate RECORDS OUT           records with stored scores -> summary
    python -m tallyloom.run prompt RECORDS OUT             the first records as examples, the next as the target -> one prompt

RECORDS is a folder that one of these wrote, or Parquet, or JSON. Sets are read back with sources.publish.published().
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import prompt, provider
from tallyloom.operators import evaluate as ev
from tallyloom.plans import loocv
from tallyloom.sources import files
from tallyloom.sources.publish import publish, published

PREFIX = "TALLYLOOM_"
_TRUE = {"1", "true", "yes", "on"}


def provider_from(env: Mapping[str, str]) -> Callable[[], provider.Provider]:
    """The factory that PROVIDER names: fixed (no model), http (URL, MODEL, TIMEOUT), local (MODEL, SEED, TEMPERATURE, MAX_TOKENS)."""
    get = lambda name, other="": env.get(PREFIX + name, other)
    kind = get("PROVIDER", "fixed")
    if kind == "fixed":
        return provider.fixed_answers
    if kind == "http":
        options = {k: float(v) if k == "temperature" else int(v) for k, v in (("seed", get("SEED")), ("temperature", get("TEMPERATURE"))) if v}
        return provider.http_provider(get("URL"), get("MODEL"), float(get("TIMEOUT", "120")), **options)
    if kind == "local":
        return provider.local_provider(get("MODEL"), int(get("MAX_TOKENS", "256")), float(get("TEMPERATURE", "0")), seed=int(get("SEED")) if get("SEED") else None)
    raise ValueError(f"unknown provider: {kind}")


def settings_from(env: Mapping[str, str]) -> loocv.Settings:
    """Settings from variables with PREFIX; what isn't there stays as Settings has it."""
    read = {
        "num_examples": int, "style": str, "batched": lambda x: x.lower() in _TRUE, "passes": int, "aggregate": str, "calibration": str, "blend_weight": float,
        "limit": int, "balanced": int, "partitions": int, "store": str, "window": int, "retries": int,
    }
    given = {name: kind(env[PREFIX + name.upper()]) for name, kind in read.items() if env.get(PREFIX + name.upper())}
    return loocv.Settings(**given, make_provider=provider_from(env))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a published set, or of files; without a column pos, their order by id."""
    found = published(spark, path).get("records")
    records = spark.read.parquet(found) if found else files.read_dataset(spark, path)
    return records if "pos" in records.columns else loocv.with_positions(records)


def enrich(spark: SparkSession, sheet: str, projects: str, out: str) -> dict[str, str]:
    """projects: Parquet or JSON lines of (project_id, json)."""
    raw = spark.read.parquet(projects) if projects.rstrip("/").endswith(".parquet") else spark.read.schema("project_id long, json string").json(projects)
    return publish({"records": loocv.enrich(files.read_sheet(spark, sheet), raw)}, out)


def _with_summary(facts: DataFrame, out: str) -> dict[str, str]:
    spark = facts.sparkSession
    paths = publish({"facts": facts}, out)
    return publish({"summary": ev.summary_long(ev.summary(spark.read.parquet(paths["facts"]))).coalesce(1)}, out)


def leave_one_out(spark: SparkSession, records: str, out: str, settings: loocv.Settings) -> dict[str, str]:
    return _with_summary(loocv.leave_one_out(read_records(spark, records), settings), out)


def evaluate(spark: SparkSession, records: str, out: str) -> dict[str, str]:
    facts = loocv.stored_facts(read_records(spark, records))
    return _with_summary(facts.select(F.col("pos").alias("sample_id"), "dimension", "actual", "predicted"), out)


def make_prompt(spark: SparkSession, records: str, out: str, settings: loocv.Settings) -> dict[str, str]:
    return publish({"prompt": prompt.of_records(read_records(spark, records), settings.num_examples, settings.style)}, out)


def main(args: list[str], env: Mapping[str, str] = os.environ) -> dict[str, str]:
    programs = {"enrich": 4, "leave-one-out": 3, "evaluate": 3, "prompt": 3}
    if not args or programs.get(args[0]) != len(args):
        sys.exit(__doc__)
    spark = SparkSession.builder.getOrCreate()
    name, *paths = args
    if name == "enrich":
        return enrich(spark, *paths)
    if name == "evaluate":
        return evaluate(spark, *paths)
    return (leave_one_out if name == "leave-one-out" else make_prompt)(spark, *paths, settings_from(env))


if __name__ == "__main__":
    for table, path in main(sys.argv[1:]).items():
        print(table, path)
