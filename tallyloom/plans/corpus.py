"""Deterministic corpora over the standard tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.dims import DIMENSIONS, SHEET_COLUMNS
from tallyloom.sources.projects import Projects

# The corpus' opcodes, in order.
OPCODES = [
    "event_whenflagclicked", "event_whenkeypressed", "event_broadcast", "event_whenbroadcastreceived",
    "control_repeat", "control_forever", "control_if", "control_if_else",
    "control_wait", "control_create_clone_of", "data_setvariableto", "data_changevariableby",
    "data_addtolist", "data_itemoflist", "data_listcontainsitem", "operator_add",
    "operator_and", "motion_gotoxy", "motion_changexby", "motion_ifonedgebounce",
    "looks_say", "looks_switchcostumeto", "looks_nextcostume", "sound_play",
    "sensing_touchingobject", "procedures_definition", "procedures_call", "argument_reporter",
    "looks_setsizeto", "motion_movesteps", "sensing_askandwait", "pen_stamp",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1: every event is a block of a project; a block's parent is the one before it on its target."""
    opcodes = ", ".join(f"'{x}'" for x in OPCODES)
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", "ts", F.expr("cast(floor(value) as bigint)").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"))
        .selectExpr(
            "case when user_id % 5 = 0 then user_id * 10 else user_id * 10 + 1 + event_id % 6 end as project_id",
            "cast(event_id % 4 as int) as target_idx",
            "event_id as block_id",
            "ts",
            "k",
            f"element_at(array({opcodes}), cast((event_id * 7 + user_id * 13 + v) % 32 as int) + 1) as opcode",
        )
    )


def block_projects(spark: SparkSession, sf_dir: str) -> Projects:
    """C1 as Projects: target 0 is the stage; some opcodes name a variable, a list, a comment or a broadcast by their k."""
    rows = block_rows(spark, sf_dir)
    name = "case target_idx when 0 then 'Stage' when 3 then 'Game Over' else concat('Sprite', target_idx) end"
    variable = "case when opcode = 'data_setvariableto' then case k % 4 when 0 then 'score' when 1 then concat('var', k) when 2 then 'lives' else 'speed' end end"
    listed = "case when opcode = 'data_addtolist' then case when k % 3 = 0 then 'list1' else concat('inventory', k % 3) end end"
    keyed = rows.selectExpr("*", f"{name} as target_name", f"{variable} as variable", f"{listed} as list")
    targets = keyed.groupBy("project_id", "target_idx", "target_name").agg(
        (F.col("target_idx") == 0).alias("is_stage"),
        F.count_distinct("variable").alias("variables"),
        F.count_distinct("list").alias("lists"),
        F.lit(0).cast("long").alias("sounds"),
        F.lit(0).cast("long").alias("costumes"),
    )
    blocks = keyed.selectExpr(
        "project_id",
        "target_idx",
        "target_name",
        "cast(block_id as string) as block_id",
        "opcode",
        "cast(lag(block_id) over (partition by project_id, target_idx order by ts, block_id) as string) as parent_id",
        "case when opcode in ('event_broadcast', 'event_whenbroadcastreceived') then concat('msg', k % 5) end as broadcast_name",
    )
    names = (
        keyed.select("project_id", "target_idx", F.explode(F.create_map(F.lit("variable"), "variable", F.lit("list"), "list")).alias("kind", "name"))
        .filter("name is not null")
        .distinct()
        .select("project_id", "kind", "name")
    )
    comments = keyed.filter("opcode = 'pen_stamp'").selectExpr(
        "project_id", "case k % 3 when 0 then 'debug me' when 1 then 'Fix the component' else 'note' end as text"
    )
    return Projects(rows.select("project_id").distinct(), targets, blocks, names, comments)


def raw_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 as raw JSON, (project_id, json): what a project's address answers."""
    p = block_projects(spark, sf_dir)
    key = ["project_id", "target_idx"]
    block = F.struct(
        F.col("opcode"),
        F.col("parent_id").alias("parent"),
        F.when(F.col("broadcast_name").isNotNull(), F.struct(F.array("broadcast_name", "block_id").alias("BROADCAST_OPTION"))).alias("fields"),
    )
    blocks = p.blocks.groupBy(*key, "target_name").agg(F.map_from_entries(F.collect_list(F.struct("block_id", block))).alias("blocks"))
    rows = block_rows(spark, sf_dir).selectExpr("project_id", "target_idx", "block_id", "opcode", "k")
    variable = "case when opcode = 'data_setvariableto' then case k % 4 when 0 then 'score' when 1 then concat('var', k) when 2 then 'lives' else 'speed' end end"
    listed = "case when opcode = 'data_addtolist' then case when k % 3 = 0 then 'list1' else concat('inventory', k % 3) end end"
    said = "case when opcode = 'pen_stamp' then case k % 3 when 0 then 'debug me' when 1 then 'Fix the component' else 'note' end end"
    named = lambda c: F.map_from_entries(F.transform(F.array_sort(F.collect_set(F.expr(c))), lambda x: F.struct(x, F.array(x, F.lit("0")))))
    owned = rows.groupBy(*key).agg(
        named(variable).alias("variables"),
        named(listed).alias("lists"),
        F.map_from_entries(F.collect_list(F.when(F.expr(said).isNotNull(), F.struct(F.col("block_id").cast("string"), F.struct(F.expr(said).alias("text")))))).alias("comments"),
    )
    target = F.struct(
        (F.col("target_idx") == 0).alias("isStage"), F.col("target_name").alias("name"), "blocks", "variables", "lists", "comments"
    )
    texts = blocks.join(owned, key).select(*key, F.to_json(target).alias("text"))
    whole = texts.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("target_idx", "text"))).alias("t"))
    return whole.select("project_id", F.concat(F.lit('{"targets":['), F.array_join("t.text", ","), F.lit("]}")).alias("json"))


def project_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet over C1's projects, in order: by URL or ID, with a second reviewer for some, and rows whose project isn't there."""
    ids = block_rows(spark, sf_dir).select("project_id").distinct()
    rows = ids.selectExpr("project_id", "explode(if(project_id % 10 = 0, array(1, 2), array(1))) as Reviewer").selectExpr(
        "project_id as n", "case when project_id % 50 = 1 then project_id + 1000000000 else project_id end as project_id", "Reviewer"
    )
    grade = lambda i: F.nullif((F.col("n") + i + F.col("Reviewer")) % 7, F.lit(6)).cast("double")
    return rows.orderBy("n", "Reviewer").select(
        F.when(F.col("n") % 3 == 0, F.col("project_id")).alias("ID"),
        F.when(F.col("n") % 3 != 0, F.concat(F.lit("https://example.com/projects/"), "project_id", F.lit("/"))).alias("URL"),
        "Reviewer",
        *(grade(i).alias(c) for i, c in enumerate(SHEET_COLUMNS, 1)),
    )


def dimension_rows(spark: SparkSession) -> DataFrame:
    """(dim_idx from 1, dimension): twenty rows."""
    return spark.createDataFrame([(i, d) for i, d in enumerate(DIMENSIONS, 1)], "dim_idx int, dimension string")


def with_dimensions(df: DataFrame) -> DataFrame:
    """Each row of df once for each dimension, without a join."""
    structs = [F.struct(F.lit(i).alias("dim_idx"), F.lit(d).alias("dimension")) for i, d in enumerate(DIMENSIONS, 1)]
    return df.select("*", F.inline(F.array(*structs)))


#: Rows that each become many facts go to tasks about so many at a time.
SPREAD_ROWS = 10_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key into tasks of about SPREAD_ROWS rows, so that what is made of a small file isn't made, and grouped, by one task."""
    return df.repartition(max(1, -(-df.count() // SPREAD_ROWS)), key)


def grade_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2: (sample_id, dim_idx, dimension, actual, predicted), dealt out by sample_id."""
    return (
        with_dimensions(spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"))
        .selectExpr("c_custkey as sample_id", "dim_idx", "dimension", "(c_custkey * 7 + dim_idx * 3) % 6 as actual")
        .selectExpr("*", "(actual + case when sample_id * dim_idx % 4 = 0 then 1 else 0 end) % 6 as predicted")
    )


def pass_facts(spark: SparkSession, sf_dir: str, passes: int = 3) -> DataFrame:
    """C3: (sample_id, dimension, pass, predicted)."""
    return (
        grade_facts(spark, sf_dir)
        .select("sample_id", "dim_idx", "dimension", "actual", F.explode(F.array(*map(F.lit, range(passes)))).alias("pass"))
        .selectExpr("sample_id", "dimension", "pass", "(actual + (sample_id + pass * dim_idx) % 4) % 6 as predicted")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: (conv_id, turn, response): what models answer, whole and broken."""
    g = F.col("turn") % 6
    text = (
        F.when(F.col("c") == 0, F.concat(F.lit('Sure:\n```json\n{"loops": '), g, F.lit(', "math": 2.9}\n```')))
        .when(F.col("c") == 1, F.concat(F.lit('Result {"loops": '), g, F.lit(', "lists": 4} done')))
        .when(F.col("c") == 2, F.concat(F.lit('{"loops": '), g, F.lit(", ")))
        .when(F.col("c") == 3, F.concat(F.lit('{"loops": "g", "math": true, "lists": '), g, F.lit("}")))
        .otherwise("no grades here")
    )
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 5).alias("c"))
        .select("conv_id", "turn", text.alias("response"))
    )


def label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5: ID, URL and one column for each dimension, 6 as null."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    grade = lambda i: F.nullif((F.col("o_orderkey") + i) % 7, F.lit(6)).cast("double")
    return orders.select(
        F.col("o_orderkey").alias("ID"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("https://example.com/projects/"), "o_custkey", F.lit("/"))).alias("URL"),
        *(grade(i).alias(c) for i, c in enumerate(SHEET_COLUMNS, 1)),
    )
