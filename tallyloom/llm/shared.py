"""What several operators of this subpackage need: reading, cutting lineage, bitmaps, components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.lineage import shared_dir, shuffles_dropped

MAX_ROUNDS = 64
BITMAP_BITS = 26


BATCH_ROWS = 2000
_memos: list[tuple[str, Callable[[], None]]] = []
_state = {"owner": ""}


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts come to Python BATCH_ROWS at a time, or fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def memo(owner: str, clear: Callable[[], None]) -> None:
    """Tells enter() how to empty what an operator keeps in a Python worker between tasks."""
    _memos.append((owner, clear))


def enter(owner: str) -> None:
    """Called by a task as it starts: what other operators have left in this worker goes, and its memory with it."""
    if _state["owner"] == owner:
        return
    _state["owner"] = owner
    for other, clear in _memos:
        if other != owner:
            clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back.

    This ends the lineage: what was written survives the loss of any executor, and values such as
    monotonically_increasing_id() stay as they were first drawn.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Deletes what cut() wrote for each of them, once nothing reads it any more: no result may hang on it unwritten."""
    for df in cuts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def may_hold(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that is true for every value of keys and false for most others, by a bitmap of 8 MB at most.

    With very many keys it lets everything pass: it saves a shuffle, but never decides.
    """
    keys = keys.select(key).distinct()
    bits = min(BITMAP_BITS, max(12, (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = (
        keys.select(place(F.col(key)).alias("p"))
        .groupBy(F.expr("shiftright(p, 6)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask"))
    )
    bitmap = np.zeros(1 << bits - 6, dtype=np.int64)
    for word, mask in words.collect():  # bounded by the bitmap
        bitmap[word] = mask
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(p: pd.Series) -> pd.Series:
        p = p.to_numpy()
        return pd.Series((shared.value[p >> 6] >> (p & 63) & 1).astype(bool))

    return lambda column: held(place(column))


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """docs less the rows whose id is in gone; only rows that may be gone are shuffled."""
    gone = cut(gone.filter(F.col(id_col).isNotNull()).distinct())
    flag = free_name(docs, "__may_go")
    flagged = docs.withColumn(flag, may_hold(gone, id_col)(F.col(f"`{id_col}`")))
    return (
        flagged.filter(~F.col(flag))
        .union(flagged.filter(F.col(flag)).join(gone.withColumnRenamed(id_col, flag + "_id"), F.col(f"`{id_col}`") == F.col(flag + "_id"), "left_anti"))
        .drop(flag)
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node it reaches.

    Alternating star contraction: the large star ties each larger neighbour of a node to the least
    of its neighbourhood, the small star does so with the smaller ones; after few rounds every component is
    one star around its smallest node. Each round is two aggregations and two joins over the edges and ends in a
    cut; nothing but a count and a checksum, taken as it is written, reaches the driver. Joins, not windows, carry the least neighbour
    back, so that AQE can split the partition of a node with very many edges.
    """

    def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = cut(edges.observe(seen, F.count("*").alias("c"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")))
        return out, (seen.get.get("c", 0), seen.get.get("s"))

    now, last = written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct())
    for _ in range(MAX_ROUNDS if last[0] else 0):
        both = now.select(F.col("lo").alias("n"), F.col("hi").alias("m")).union(
            now.select(F.col("hi").alias("n"), F.col("lo").alias("m"))
        )
        least = both.groupBy("n").agg(F.min("m").alias("l")).select("n", F.least("n", "l").alias("l"))
        large = (
            both.filter("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("l").alias("lo")).distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("l"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("l").alias("lo")), F.struct("hi", F.col("l").alias("lo")))).alias("e"))
            .select("e.lo", "e.hi")
            .filter("lo < hi")
            .distinct()
        )
        after, state = written(small)
        discard(now)
        now = after
        if last == state:
            break
        last = state
    else:
        if last[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        now.select("lo", "lo").distinct()
    )
