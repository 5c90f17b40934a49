"""Sort-means: against a plain k-means in Python integers, and odd tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.sort_means import LARGEST, assign, cluster_vectors, order_of

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, clusters, rounds, width, scale=256):
    """(id, cluster, distance) by comparing every vector with every centroid, with the final centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])) + [r for r in kept if r[0] is None]
    centroids = [list(v) for _, v in first[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            if held := [v for (_, v), c in zip(kept, own, strict=True) if c == k]:
                centroids[k] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    return [(i, k, d) for (i, v), (d, k) in ((r, near(r[1])) for r in kept)], centroids


def test_scan_equals_full_search_with_ties():
    draw = np.random.default_rng(5)
    for width in (1, 2, 6):
        x = draw.integers(-4, 5, (800, width))
        centroids = draw.integers(-4, 5, (25, width))  # many equal, many ties
        centroids[7] = centroids[3]
        every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        start = draw.integers(0, len(centroids), len(x))
        cluster, distance = assign(x, start, centroids, *order_of(centroids))
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_against_plain_k_means(spark):
    draw = np.random.default_rng(6)
    rows = [(int(i), draw.choice([-0.5, 0.0, 0.01, 0.3], 4).tolist()) for i in draw.permutation(300)]
    rows += [(rows[0][0], rows[0][1]), (None, [0.0, 0.1, 0.2, 0.3]), (900, None), (901, [1.0] * 5), (902, []), (903, [None, 1.0, 1.0, 1.0]), (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [float("inf")] + [0.0] * 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("own")).withColumn("v", F.lit(1)).repartition(5)
    got = cluster_vectors(df, clusters=12, rounds=3, width=4).collect()
    want, centroids = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 12, 3, 4)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    spread = {k: sum(d for _, c, d in want if c == k) for k in range(12)}
    assert all(r.cluster_inertia == spread[r.cluster] and r.inertia == sum(spread.values()) for r in got)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in got)


def test_few_equal_and_no_vectors(spark):
    one = spark.createDataFrame([(1, [0.5]), (2, [0.5]), (3, [0.5])], SCHEMA)
    got = cluster_vectors(one, clusters=40, width=1).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3] and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}
    none = cluster_vectors(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(spark.createDataFrame([(1, [float(LARGEST)])], SCHEMA), width=1).collect()
