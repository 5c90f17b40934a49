"""Projects as tables: from raw nested JSON, or from block rows that are flat already.

Four tables carry everything the operators read:

    targets   project_id, target_idx, target_name, is_stage, variables, lists, sounds, costumes (entries of each)
    blocks    project_id, target_idx, target_name, block_id, opcode, parent_id, broadcast_name
    names     project_id, kind ("variable" or "list"), name
    comments  project_id, text
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

_MAP = "map<string,variant>"


@dataclass(frozen=True)
class Projects:
    """projects: project_id and, for raw JSON, parse_error; the other tables are as above."""

    projects: DataFrame
    targets: DataFrame
    blocks: DataFrame
    names: DataFrame
    comments: DataFrame


def _map(value: Column, path: str = "$") -> Column:
    """What stands at path as a map of variants; null unless it is an object."""
    return F.try_variant_get(value, path, _MAP)


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def parse_projects(raw: DataFrame, id_col: str = "project_id", json_col: str = "json", keep: bool = True) -> Projects:
    """Raw JSON texts, one project to a row, as Projects.

    A text is parsed once, into one variant; all tables are cut out of that, without reading text again. What is of another kind than it should
    be is passed over alone: a target or a block that is no object, a name that is no list. A null or empty text, and one that is no JSON
    (an object that names a key twice is none), is a project without targets, with parse_error set where there was text that is no
    object; `{}` has no targets either. keep=True writes the targets' variants once to the shared folder, as four tables come from them.
    """
    read = raw.select(F.col(id_col).alias("project_id"), F.col(json_col).alias("json"), F.try_parse_json(F.col(json_col)).alias("v"))
    text = F.trim("json")
    projects = read.select(
        "project_id",
        F.coalesce((F.length(text) > 0) & _map(F.col("v")).isNull(), F.lit(False)).alias("parse_error"),
        F.coalesce(text.isin("", "{}", "null"), F.lit(True)).alias("is_empty"),
    )
    parsed = (
        read.select("project_id", F.posexplode(F.try_variant_get("v", "$.targets", "array<variant>")).alias("target_idx", "t"))
        .filter(_map(F.col("t")).isNotNull())
    )
    if keep:
        parsed = cut(parsed)
    t = F.col("t")
    entries = lambda c: F.coalesce(F.size(_map(t, f"$.{c}")), F.lit(0)).cast("long").alias(c)
    listed = lambda c: F.coalesce(F.size(F.try_variant_get(t, f"$.{c}", "array<variant>")), F.lit(0)).cast("long").alias(c)
    stage = F.coalesce(F.try_variant_get(t, "$.isStage", "boolean"), F.lit(False))
    name = F.coalesce(_text(t, "$.name"), F.lit(""))
    targets = parsed.select(
        "project_id", "target_idx", name.alias("target_name"), stage.alias("is_stage"), entries("variables"), entries("lists"), listed("sounds"), listed("costumes")
    )
    b = F.col("b")
    opcode = F.coalesce(_text(b, "$.opcode"), F.lit(""))
    blocks = (
        parsed.select("project_id", "target_idx", name.alias("target_name"), F.explode(_map(t, "$.blocks")).alias("block_id", "b"))
        .filter(_map(b).isNotNull())
        .select(
            "project_id",
            "target_idx",
            "target_name",
            "block_id",
            opcode.alias("opcode"),
            F.nullif(_text(b, "$.parent"), F.lit("")).alias("parent_id"),
            F.when(opcode.rlike("^event_(broadcast|whenbroadcastreceived)"), _text(b, "$.fields.BROADCAST_OPTION[0]")).alias("broadcast_name"),
        )
    )
    named = [
        parsed.select("project_id", F.lit(kind).alias("kind"), F.explode(_map(t, f"$.{column}")).alias("key", "value")).select(
            "project_id", "kind", _text(F.col("value"), "$[0]").alias("name")
        )
        for kind, column in (("variable", "variables"), ("list", "lists"))
    ]
    comments = parsed.select("project_id", F.explode(_map(t, "$.comments")).alias("key", "value")).select("project_id", _text(F.col("value"), "$.text").alias("text"))
    return Projects(projects, targets, blocks, named[0].union(named[1]).filter("name is not null"), comments.filter("text <> ''"))


def read_projects(spark, path: str, keep: bool = True) -> Projects:
    """JSON lines of {"id": ..., "json": "..."} or a Parquet folder with these columns."""
    raw = spark.read.schema("id long, json string").json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return parse_projects(raw, "id", "json", keep)
