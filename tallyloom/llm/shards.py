"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes, without a global sort:

1. rows belong to source blocks, a hash of the whole row; all steps go by narrow rows of a place and two such hashes;
2. for each block the driver draws how many of its rows each shard gets: a multivariate hypergeometric draw
   without replacement from the shards' free places, so rows and columns of the matrix add up exactly;
3. each block permutes its rows by a keyed hash and cuts the permutation by its row of the matrix;
4. rows are exchanged by (shard, bucket), where the bucket is a second keyed hash, and permuted again there;
5. whole rows are moved once, to their shard and slot.

The driver holds blocks x shards counts, about one per BLOCK_ROWS / shards rows or BLOCK_BYTES / shards of text, never a row. No task
holds more than a block or a bucket, neither of which depends on any one value of a column: rows that are equal in every column and
would fill a good part of a block are dealt out by their place in the table instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_name

BLOCK_ROWS = 250_000
BLOCK_BYTES = 256_000_000
LEAST_BLOCKS = 64
#: So many equal rows to a block may share it by their hash.
EQUAL_SHARE = 16


def shard_rows(
    df: DataFrame, shards: int = 16, seed: int = 17, block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """df with shard (int, 0 to shards - 1) and slot (long, 0, 1, ... in each shard).

    Shard sizes differ by one row at most; with fewer rows than shards, some shards get none. Same rows, seed and
    parameters give the same shards on any cluster, unless a row occurs over block_rows / EQUAL_SHARE times, when they depend
    on how the table is partitioned. Nulls count as values, and columns may be of any type that has a JSON form, maps among them; rows equal in every column can change places without
    anything to see. An empty table gives an empty result. Columns of df named shard or slot stay,
    and the new ones get a leading underscore.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    place, shard, slot = (free_name(df, x) for x in ("__place", "shard", "slot"))
    spark, columns = df.sparkSession, [F.col(f"`{c}`") for c in df.columns]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("")
    whole = cut(df.select("*", F.monotonically_increasing_id().alias(place)), "zstd")  # written once, moved once, when all is settled
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum(wide, F.lit(8 * len(df.columns))).cast("long")
    # Two hashes of all columns stand for a row: rows that agree in both are equal, and may change places.
    rows = cut(whole.select(F.col(place).alias("place"), F.xxhash64(F.lit(seed), F.lit(0), text).alias("draw"), F.xxhash64(F.lit(seed), F.lit(5), text).alias("tie"), size.alias("size")))
    total, held = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(least_blocks, -(-total // block_rows), -(-held // block_bytes))
    buckets = max(-(-least_blocks * 2 // shards), -(-total // (shards * block_rows)), -(-held // (shards * block_bytes)), 1)
    equal = rows.groupBy("draw").count().filter(F.col("count") > block_rows // EQUAL_SHARE).select("draw").collect()  # EQUAL_SHARE a block at most
    if equal:
        equal = spark.createDataFrame(equal, "draw long").withColumn("often", F.lit(True))
        rows = rows.join(F.broadcast(equal), "draw", "left").withColumn("apart", F.when(F.col("often"), F.col("place"))).drop("often")
    else:
        rows = rows.withColumn("apart", F.lit(None).cast("long"))
    keyed = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "draw", "apart")
    rows = rows.select("place", "draw", "tie", "apart", F.pmod(keyed(1), F.lit(blocks)).cast("int").alias("block"))
    counts = {r[0]: r[1] for r in rows.groupBy("block").count().collect()}  # bounded: one row a block

    free = np.array([total // shards + (k < total % shards) for k in range(shards)], dtype=np.int64)
    dice = np.random.Generator(np.random.PCG64(seed))
    matrix = []
    for b in sorted(counts):
        taken = dice.multivariate_hypergeometric(free, counts[b], method="marginals")
        free -= taken
        matrix.append((b, [int(x) for x in np.cumsum(taken)]))
    ends = spark.createDataFrame(matrix, "block int, ends array<long>")

    order = ["draw", "tie", "place"]
    first = Window.partitionBy("block").orderBy(keyed(2), *order)
    dealt = (
        rows.withColumn("rank", F.row_number().over(first))
        .join(F.broadcast(ends), "block")  # one row a block, as on the driver
        .select(*order, "apart", F.expr("cast(size(filter(ends, x -> x < rank)) as int)").alias("shard"), F.pmod(keyed(3), F.lit(buckets)).cast("int").alias("bucket"))
    )
    again = Window.partitionBy("shard", "bucket").orderBy(keyed(4), *order)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = (
        dealt.withColumn("rank", F.row_number().over(again))
        .join(starts, ["shard", "bucket"])
        .select(F.col("place").alias(place), F.col("shard").alias(shard), (F.col("before") + F.col("rank") - 1).alias(slot))
    )
    return whole.join(placed.hint("merge"), place).select(*columns, shard, slot)
