"""Embedding near-dedup by a pivot-permutation index.

Every vector is described by its nearest pivots in order of nearness, PREFIX at most. Pivots are a sample thinned to twice the
threshold's angle (t) at least, so that a dense group gets few of them. A vector names only pivots within its nearest one's angle
plus 2 t: the nearest pivot of anything linked with it lies there. Where that takes fewer than PREFIX, the vector is settled, and
whatever is linked with it shares a pivot with it, however dense its surroundings. Each pivot has an inverted list of the
vectors that name it; two vectors are candidates when they share a pivot and one is settled, or else SHARED pivots. A
pair is looked at only in the list of the least pivot that it shares, and verified by its cosine in double precision. Equal vectors are one entry with a weight. A long list is cut into blocks, and each two blocks
are a task's work, so that no list needs to fit one task; a task gives counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, cut, discard

PREFIX = 8
SHARED = 2
BLOCK = 1024
MOST_PIVOTS = 1 << 14
THRESHOLD = 0.95
NONE = np.iinfo(np.int32).max


def pivots_for(n: int) -> int:
    """About 4 * sqrt(n), a power of two: describing a vector and searching its lists then cost about the same."""
    return min(MOST_PIVOTS, 1 << max(5, round(math.log2(4 * math.sqrt(max(n, 1))))))


def angle(cosine: np.ndarray | float) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """Lists of d numbers each, as rows in double precision."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def spaced(pivots: np.ndarray, threshold: float) -> np.ndarray:
    """The unit vectors of pivots, in order, that lie at least twice the threshold's angle from those taken before."""
    near = np.cos(min(2 * angle(threshold), np.pi))
    free, taken = np.ones(len(pivots), dtype=bool), []
    for i, pivot in enumerate(pivots):
        if free[i]:
            taken.append(i)
            free &= pivots @ pivot <= near
    return pivots[taken]


def nearest(vectors: np.ndarray, pivots: np.ndarray, prefix: int, threshold: float = THRESHOLD) -> np.ndarray:
    """For each unit vector, its nearest pivots, nearest first; ties go by number.

    Those beyond the nearest one's angle plus twice the threshold's are NONE, as is what fills up to prefix.
    """
    out = np.full((len(vectors), prefix), NONE, dtype=np.int32)
    width = min(prefix, len(pivots))
    for at in range(0, len(vectors), 1024):
        far = -(vectors[at : at + 1024] @ pivots.T)
        some = np.argpartition(far, width - 1, axis=1)[:, :width]
        some.sort(axis=1)
        order = np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable")
        some = np.take_along_axis(some, order, axis=1)
        away = angle(-np.take_along_axis(far, some, axis=1))
        out[at : at + 1024, :width] = np.where(away <= away[:, :1] + 2 * angle(threshold) + 1e-6, some, NONE)
    return out


def search_block(x: np.ndarray, named: np.ndarray, pivot: int, first: np.ndarray, part: np.ndarray, within: bool, shared: int, threshold: float):
    """Linked pairs (i, j) of a list's members whose least common pivot is this list's.

    i is in part, a part of the first block; j is in the second block or, if within (both are one block), follows i.
    """
    left = np.flatnonzero(part)
    linked = x[left] @ x.T >= threshold
    linked &= np.arange(len(x))[None, :] > left[:, None] if within else ~first[None, :]
    i, j = np.nonzero(linked)
    i = left[i]
    settled = named[:, -1] == NONE
    good = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        own, other = named[a], named[b]
        same = ((own[:, :, None] == other[:, None, :]) & (own != NONE)[:, :, None]).any(axis=2)
        least = np.where(same, own, NONE).min(axis=1)
        good[at : at + (1 << 16)] = (least == pivot) & (settled[a] | settled[b] | (same.sum(axis=1) >= shared))
    return i[good], j[good]


def near_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    prefix: int = PREFIX,
    shared: int = SHARED,
    most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """One row per row of vectors: id, n_links (long), component_id, kept.

    Linked are vectors whose cosine is at least threshold. Nulls, zero vectors and those with null or non-finite components link
    with nothing, nor do vectors of different lengths with each other. Pivots are a bounded sample, thinned by spaced(): the distinct vectors
    of the least hashes, pivots_for() of them and most_pivots at most; every vector is indexed. Copies link with each other. Repeated ids
    are rows of their own; a row without an id counts and connects, and a group of nothing else has a null
    component_id. kept is vec_id = component_id. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    # Floats stay floats on disk and in shuffles, which loses nothing: what is computed from them is in double precision.
    real = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast(real))
    sound = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = cut(
        vectors.select(F.col(f"`{id_col}`").alias("id"), sound.alias("sound"), F.when(sound, v).alias("v")).select(
            "id", "sound", F.transform("v", lambda x: x + F.lit(0.0).cast(real)).alias("v"), F.monotonically_increasing_id().alias("row")
        )
    )
    copies = cut(
        rows.filter("sound").groupBy("v").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("id").alias("id"))
    )
    n = copies.count()
    k = min(most_pivots, pivots_for(n))
    # By Arrow: as numbers in arrays, not as Python objects.
    sample = copies.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(k).select("v").toArrow().column("v").combine_chunks()
    length = pc.list_value_length(sample)
    unit = {d: matrix(sample.filter(pc.equal(length, d)), d) for d in pc.unique(length).to_pylist()}
    pivots = spark.sparkContext.broadcast({d: spaced(x / np.linalg.norm(x, axis=1, keepdims=True), threshold) for d, x in unit.items()})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("v")
            length = pc.list_value_length(own).to_numpy(zero_copy_only=False)
            named = np.empty((len(own), prefix), dtype=np.int32)
            for d in np.unique(length).tolist():
                some = np.flatnonzero(length == d)
                if d in pivots.value:
                    x = matrix(own.take(pa.array(some)), d)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    named[some] = nearest(x, pivots.value[d], prefix, threshold)
                else:  # vectors of a length that the sample lacks are compared under one list of their own
                    named[some] = [-d, *[NONE] * (prefix - 1)]
            named = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * prefix, pa.int32()), pa.array(named.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("weight"), own, named], ["node", "weight", "v", "named"]
            )

    described = cut(
        copies.select("node", "weight", "v").mapInArrow(describe, f"node long, weight long, v array<{real}>, named array<int>")
    )
    listed = described.select("node", "weight", "v", "named", F.explode("named").alias("pivot"), F.size("v").alias("d")).filter(f"pivot <> {NONE}")
    blocks = listed.groupBy("pivot", "d").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    placed = (
        listed.join(blocks, ["pivot", "d"])
        .withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "weight", "v", "named", "pivot", "d", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    )

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        pivot, d, i, j = (x.as_py() for x in key)
        node, weight = held.column("node").to_numpy(), held.column("weight").to_numpy()
        x = matrix(held.column("v").combine_chunks(), d)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        named = held.column("named").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        first = held.column("block").to_numpy() == i
        total, label = np.zeros(len(node), np.int64), np.arange(len(node))
        tied = []
        for at in np.array_split(np.flatnonzero(first), max(1, -(-int(first.sum()) // 256))):
            part = np.zeros(len(node), dtype=bool)
            part[at] = True
            a, b = search_block(x, named, pivot, first, part, i == j, min(shared, prefix), threshold)
            np.add.at(total, a, weight[b])
            np.add.at(total, b, weight[a])
            for one in np.unique(a):
                others = b[a == one]
                new = others[label[others] != label[one]]
                if len(new):
                    for other in dict(zip(label[new].tolist(), new.tolist(), strict=True)).values():
                        tied.append((int(node[one]), int(node[other])))
                    joined = np.isin(label, np.append(label[new], label[one]))
                    label[joined] = label[joined].min()
        some = np.flatnonzero(total)
        a, b = zip(*tied, strict=True) if tied else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*node[some].tolist(), *a], pa.int64()), pa.array([None] * len(some) + list(b), pa.int64()), pa.array([*total[some].tolist(), *[0] * len(a)], pa.int64())],
            ["a", "b", "links"],
        )

    found = cut(placed.groupBy("pivot", "d", "i", "j").applyInArrow(search, "a long, b long, links long"))
    discard(described)
    links = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("b is not null"))
    whole = copies.join(links, "node", "left").join(component, "node", "left").select(
        "v", "node", "id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")
    )
    least = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    named = whole.join(least, "component").select("v", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    # Rows without a sound vector get a key of their own, so that they don't meet in one task.
    alone = F.when(F.col("sound"), F.col("v")).otherwise(F.array(F.lit(float("nan")).cast(real), *(F.expr(f"cast({x} as {real})") for x in ("row & 16777215", "row >> 24"))))
    return (
        rows.withColumn("v", alone)
        .join(named, "v", "left")
        .select(
            F.col("id").cast(kind).alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )
