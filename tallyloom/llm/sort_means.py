"""Centroid clustering by sort-means over integer vectors.

A round orders, for every centroid, the others by their distance from it. A vector is scanned from the centroid that it was assigned
to in the round before: centroids come nearest to that one first, and the scan stops at the first that lies strictly beyond twice the vector's
distance from it, as none from there on can be nearer or as near. All arithmetic is in integers, so that neither the order of rows nor their
partitioning changes a result. The driver holds centroids only, k times d numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard

CLUSTERS = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256
#: Up to this, four times a squared distance of WIDTH components fits 63 bits.
LARGEST = 1 << 26
CHUNK = 4096


def order_of(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid, all by their squared distance from it (itself first, ties by number), and these distances."""
    away = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    ranked = away.copy()
    np.fill_diagonal(ranked, -1)  # itself before any equal one
    order = np.argsort(ranked, axis=1, kind="stable")
    return order, np.take_along_axis(away, order, axis=1)


def assign(x: np.ndarray, start: np.ndarray, centroids: np.ndarray, order: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row of x, scanned from start. Ties go to the smaller number."""
    best, dist = start.copy(), ((x - centroids[start]) ** 2).sum(axis=1)
    reach = 4 * dist  # twice the distance from start, squared
    live = np.arange(len(x))
    for step in range(1, len(centroids)):
        live = live[away[start[live], step] <= reach[live]]  # strictly beyond: stop
        if not len(live):
            break
        other = order[start[live], step]
        d = ((x[live] - centroids[other]) ** 2).sum(axis=1)
        nearer = (d < dist[live]) | ((d == dist[live]) & (other < best[live]))
        best[live[nearer]], dist[live[nearer]] = other[nearer], d[nearer]
    return best, dist


def _assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows (id, v, cluster) with cluster and distance after a round over these centroids."""
    table = np.array(centroids, dtype=np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((table, *order_of(table)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                x = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
                cluster, distance = assign(x, batch.column("cluster").to_numpy().astype(np.int64), *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v", "cluster").mapInArrow(scan, f"id {kind}, v array<int>, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: str = "2",
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly width components, none null, NaN or infinite; every component x becomes floor(scale * x). The first centroids are
    the kept vectors of the smallest sha256 of "seed:id", in that order; rows without an id are clustered, but never a
    first centroid unless there are too few others. Of repeated ids, the vector that sorts first comes first. With fewer vectors than clusters, each
    is a first centroid. A round assigns every vector to the nearest centroid by squared distance (ties: smaller number) and moves every centroid that has
    any to the componentwise floor of their mean; after the rounds, all are assigned once more. An empty table gives an empty result; other columns are
    not read. Components beyond LARGEST after scaling raise an error, as their
    squared distances would leave a long.

    Every round reads the vectors with their last assignments from the shared folder and writes them with the new ones; what the round before
    wrote is deleted. Nothing is shuffled but k sums a task.
    """
    v = F.col(f"`{vector_col}`")
    sound = F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("w", lambda x: F.abs(x) <= min(LARGEST, int((2**59 / max(width, 1)) ** 0.5)))
    fits = F.when(small, F.transform("w", lambda x: x.cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>"))
    rows = cut(
        vectors.filter(sound)
        .select(F.col(f"`{id_col}`").alias("id"), scaled.alias("w"))
        .select("id", fits.alias("v"), F.lit(0).alias("cluster"))
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select("id", "v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()  # clusters rows
    centroids = [list(r.v) for r in first]
    if not centroids:
        centroids = [[0] * width]
    for _ in range(rounds):
        after = cut(_assigned(rows, centroids))
        discard(rows)
        rows = after
        sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)))
        for r in sums.collect():  # clusters rows
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
    last = cut(_assigned(rows, centroids))
    discard(rows)
    spread = {r.cluster: r.s for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # clusters rows
    facts = [
        (c, spread.get(c, 0), sum(spread.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)
    ]
    known = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(known), "cluster").select(  # clusters rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
