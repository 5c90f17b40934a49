"""Choosing labelled examples: MMR, coverage, contrast.

Records have pos (their order, from 0), id, the columns of project_features() and grades (array<int> in the order of DIMENSIONS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.index import index_of, most_similar, near_pairs
from tallyloom.operators.similar import candidates, nearest
from tallyloom.plans.dims import DIMENSIONS, FEATURES
from tallyloom.sources.lineage import cut

#: Where records have so many different grades at most, MMR looks for the best of each.
MOST_KINDS = 64
#: Similarities that differ by less than MMR's rounding may change places, so that some more are taken.
SPARE = 8


def mmr_weights(pairs: DataFrame) -> DataFrame:
    """(test_pos, test_id, similarity_weight, diversity_weight) from how alike a test's eight best candidates are."""
    top = nearest(pairs, 8).groupBy("test_pos", "test_id").agg(F.avg("similarity").alias("m"), F.stddev_pop("similarity").alias("s"))
    cv = F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0)
    w = F.when(cv <= 0.12, 0.62).when(cv >= 0.35, 0.84).otherwise(0.62 + 0.22 * (cv - 0.12) / (0.35 - 0.12))
    w = F.when(F.col("m") < 12, F.least(F.lit(0.90), w + 0.04)).otherwise(w)
    return top.select("test_pos", "test_id", w.alias("similarity_weight"), (1 - w).alias("diversity_weight"))


def mmr_examples(records: DataFrame, tests: DataFrame, k: int) -> DataFrame:
    """(test_pos, test_id, rank, pos, id, similarity): k examples of each test, alike to it but unlike one another in grades.

    Each pick maximises similarity_weight * similarity + diversity_weight * least mean grade distance to those picked before; ties go by
    pos. A candidate that couldn't win even at the greatest distance that grades allow is left out beforehand, which changes no
    pick and leaves a pool of about k for the one grouped step. Of equal features and grades only the first k + 1 by pos can be picked, and where
    grades are of few kinds, only the k most alike of each kind: one of a kind is as far from what was picked as any other.
    """
    ends = records.agg(F.count("*").alias("n"), F.max(F.array_max("grades")).alias("hi"), F.min(F.array_min("grades")).alias("lo")).first()
    total = ends.n
    k = min(k, total - 1)
    if k <= 0:
        return candidates(records, tests).limit(0).withColumn("rank", F.lit(1)).select("test_pos", "test_id", "rank", "pos", "id", "similarity")
    least = min(total - 1, max(2 * k, k + 2))
    kind = F.xxhash64("grades")
    few = records.select(kind).distinct().limit(MOST_KINDS + 1).count() <= MOST_KINDS
    index = index_of(records, least, kind=kind if few else None)
    few = few and index.cells is not None
    reach = float(max(ends.hi or 0, 0) - min(ends.lo or 0, 0))
    weights = cut(mmr_weights(most_similar(records, tests, 8, least, index)).drop("test_id"))
    weighed = tests.join(weights.withColumnRenamed("test_pos", "pos").hint("merge"), "pos")
    copies = Window.partitionBy(*FEATURES, "grades").orderBy("pos")
    first = records.withColumn("__copy", F.row_number().over(copies)).filter(F.col("__copy") <= k + 1).drop("__copy")
    pairs = near_pairs(first, weighed, k, index, F.col("diversity_weight") * reach / F.col("similarity_weight"), few)
    if few:
        best = Window.partitionBy("test_pos", "kind").orderBy(F.round("similarity", 9).desc(), "pos")
        pairs = pairs.withColumn("__best", F.row_number().over(best)).filter(F.col("__best") <= k + SPARE).drop("__best", "kind")
    w = Window.partitionBy("test_pos")
    ranked = pairs.withColumn("rank", F.row_number().over(w.orderBy(F.col("similarity").desc(), "pos")))
    kth = ranked.filter(F.col("rank") == k).select("test_pos", F.col("similarity").alias("kth"))
    pool = (
        ranked.drop("rank")
        .join(weights.hint("merge"), "test_pos")
        .join(kth.hint("merge"), "test_pos", "left")
        .filter(F.col("kth").isNull() | (F.col("similarity_weight") * F.col("similarity") >= F.col("similarity_weight") * F.col("kth") - F.col("diversity_weight") * reach - 1e-6))
        .join(records.select("pos", "grades").hint("merge"), "pos")
    )

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        given = [[0 if g is None else g for g in (x if x is not None else [])] for x in pdf["grades"]]
        graded = np.array([len(x) > 0 for x in given])
        grades = np.array([x or [0] * len(DIMENSIONS) for x in given])
        alike = pdf["similarity_weight"].iloc[0] * pdf["similarity"].to_numpy()
        far, free, chosen = np.full(len(pdf), np.inf), np.ones(len(pdf), dtype=bool), []
        for _ in range(min(k, len(pdf))):
            new = np.where(graded & np.isfinite(far), far, 0.0)
            worth = np.round(alike + pdf["diversity_weight"].iloc[0] * new, 9)  # sums of like parts are ties, in whichever order they were added
            best = int(np.argmax(np.where(free, worth, -np.inf)))  # the first of equals
            chosen.append(best)
            free[best] = False
            far = np.minimum(far, np.abs(grades - grades[best]).sum(axis=1) / len(DIMENSIONS))
        out = pdf.loc[chosen, ["test_pos", "test_id", "pos", "id", "similarity"]].copy()
        out.insert(2, "rank", range(1, len(chosen) + 1))
        return out

    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pool.groupBy("test_pos").applyInPandas(
        pick, f"test_pos {types['test_pos']}, test_id {types['test_id']}, rank int, pos {types['pos']}, id {types['id']}, similarity double"
    )


def _weights_of(similarities: np.ndarray) -> tuple[float, float]:
    """mmr_weights() of one test, from the similarities of its eight best candidates."""
    mean = similarities.mean()
    cv = similarities.std() / mean if mean > 0 else 0.0
    w = 0.62 if cv <= 0.12 else 0.84 if cv >= 0.35 else 0.62 + 0.22 * (cv - 0.12) / (0.35 - 0.12)
    w = min(0.90, w + 0.04) if mean < 12 else w
    return w, 1 - w


def mmr_held_out(records: DataFrame, k: int) -> DataFrame:
    """(test_pos, rank, pos, similarity): mmr_examples(records, records, k), where records of the same features are one test.

    Such records see the same similarities, so that they have one pair of weights, and those that are not among the picks share these; those
    that are (k at most) get picks without themselves. Where grades are of more than a few kinds, every record is a test of its own.
    """
    ends = records.agg(F.count("*").alias("n"), F.max(F.array_max("grades")).alias("hi"), F.min(F.array_min("grades")).alias("lo")).first()
    total, columns = ends.n, ("test_pos", "rank", "pos", "similarity")
    k = min(k, total - 1)
    kind = F.xxhash64("grades")
    given = records.select(kind.alias("kind"), "grades").distinct().limit(MOST_KINDS + 1).collect()
    index = index_of(records, min(total - 1, max(2 * k, k + 2)), kind=kind) if 0 < k and len(given) <= MOST_KINDS else None
    if index is None or index.cells is None:
        return mmr_examples(records, records, k).select(*columns)
    own, many = F.struct(*FEATURES), max(k + 1, 9)
    copies = Window.partitionBy(*FEATURES, "grades").orderBy("pos")
    first = records.withColumn("__copy", F.row_number().over(copies)).filter(F.col("__copy") <= many)
    kinds = first.groupBy(*FEATURES, "grades").agg(F.sort_array(F.collect_list("pos")).alias("all"))  # many at most
    kinds = cut(
        kinds.select(*FEATURES, "grades", F.col("all")[0].alias("pos"), F.size("all").alias("n"), F.slice("all", 1, k + 1).alias("members"))
        .withColumn("head", F.min("pos").over(Window.partitionBy(*FEATURES)))
        .withColumn("id", F.col("pos"))
    )
    classes = kinds.filter("pos = head").drop("grades", "n", "members", "head")
    reach = float(max(ends.hi or 0, 0) - min(ends.lo or 0, 0))
    widest = F.lit(0.38 * reach / 0.62)  # of the weights that there are
    pairs = near_pairs(kinds, classes.withColumn("pos", -1 - F.col("pos")), many - 1, index, widest, True, ("n", "members", "head"))
    best = Window.partitionBy("test_pos", "kind").orderBy(F.round("similarity", 9).desc(), "pos")
    pairs = pairs.withColumn("__best", F.row_number().over(best)).filter(F.col("__best") <= many + SPARE)
    pool = pairs.groupBy("test_pos").agg(F.collect_list(F.struct("kind", "pos", "n", "members", (F.col("head") == -1 - F.col("test_pos")).alias("same"), "similarity")).alias("p"))
    graded = {r.kind: [0 if g is None else g for g in r.grades or []] for r in given}
    place = {x: i for i, x in enumerate(graded)}
    shown = np.array([bool(x) for x in graded.values()])
    grades = np.array([x or [0] * len(DIMENSIONS) for x in graded.values()])
    apart = np.abs(grades[:, None] - grades[None]).sum(axis=2) / len(DIMENSIONS)

    def greedy(alike: np.ndarray, weight: float, kind_of: np.ndarray, free: np.ndarray) -> list[int]:
        """As mmr_examples() picks; candidates are in order of pos."""
        far, free, chosen = np.full(len(alike), np.inf), free.copy(), []
        for _ in range(min(k, int(free.sum()))):
            new = np.where(shown[kind_of] & np.isfinite(far), far, 0.0)
            at = int(np.argmax(np.where(free, np.round(alike + weight * new, 9), -np.inf)))
            chosen.append(at)
            free[at] = False
            far = np.minimum(far, apart[kind_of[at]][kind_of])
        return chosen

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, without, found = [], [], []
            for test, rows in zip(batch.column("test_pos").to_pylist(), batch.column("p"), strict=True):
                p = rows.values
                alike, n = p.field("similarity").to_numpy(), p.field("n").to_numpy().astype(int)
                n[np.argmax(alike)] -= 1  # the test itself
                order = np.argsort(-alike, kind="stable")
                similarity_weight, diversity_weight = _weights_of(np.repeat(alike[order], n[order])[:8])
                members = p.field("members")
                sizes = members.value_lengths().to_numpy()
                pos = members.flatten().to_numpy()
                by = np.argsort(pos, kind="stable")
                kind_of = np.repeat(np.array([place[x] for x in p.field("kind").to_pylist()]), sizes)[by]
                same = np.repeat(p.field("same").to_numpy(zero_copy_only=False), sizes)[by]
                pos, alike = pos[by], np.repeat(alike, sizes)[by]
                everyone = np.ones(len(pos), bool)
                picks = greedy(similarity_weight * alike, diversity_weight, kind_of, everyone)
                for out in [None, *(i for i in picks if same[i])]:
                    if out is not None:
                        free = everyone.copy()
                        free[out] = False
                        picks = greedy(similarity_weight * alike, diversity_weight, kind_of, free)
                    heads.append(-1 - test)
                    without.append(None if out is None else int(pos[out]))
                    found.append([{"pos": int(pos[i]), "similarity": float(alike[i])} for i in picks])
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(without, pa.int64()), pa.array(found, pa.list_(pa.struct([("pos", pa.int64()), ("similarity", pa.float64())])))], ["head", "without", "picks"])

    picked = pool.mapInArrow(visit, "head long, without long, picks array<struct<pos: long, similarity: double>>")
    shared = picked.groupBy("head").agg(
        F.first(F.when(F.col("without").isNull(), F.col("picks")), ignorenulls=True).alias("picks"),
        F.collect_list(F.when(F.col("without").isNotNull(), F.struct("without", "picks"))).alias("others"),  # k at most
    )
    whole = classes.select(F.col("pos").alias("head"), own.alias("f"), F.xxhash64(own).alias("h")).join(shared.hint("merge"), "head").drop("head")
    each = records.select(F.col("pos").alias("test_pos"), own.alias("own"), F.xxhash64(own).alias("h")).join(whole.hint("merge"), "h").filter("own <=> f")
    mine = F.coalesce(F.get(F.filter("others", lambda x: x["without"] == F.col("test_pos")), F.lit(0))["picks"], F.col("picks"))
    return each.select("test_pos", F.posexplode(mine).alias("rank", "e")).select("test_pos", (F.col("rank") + 1).alias("rank"), "e.pos", "e.similarity")


def first_examples(records: DataFrame, tests: DataFrame, k: int) -> DataFrame:
    """(test_pos, test_id, rank, pos, id): the first k records other than the test itself."""
    head = records.select("pos", "id").orderBy("pos").limit(k + 1)  # k + 1 rows of two numbers
    pairs = tests.select(F.col("pos").alias("test_pos"), F.col("id").alias("test_id")).join(F.broadcast(head), F.col("pos") != F.col("test_pos"))
    w = Window.partitionBy("test_pos").orderBy("pos")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("test_pos", "test_id", "rank", "pos", "id")


def with_first_examples(records: DataFrame, k: int) -> DataFrame:
    """(test_pos, features, examples) of every record: the first k others as array<struct(rank, pos, similarity, features, grades)>.

    Without a join by record: the k + 1 that may be examples are one value beside each. similarity is null.
    """
    own = F.struct(*FEATURES).alias("features")
    head = records.select("pos", own, "grades").orderBy("pos").limit(k + 1)
    one = head.agg(F.sort_array(F.collect_list(F.struct("pos", "features", "grades"))).alias("head"))
    others = F.slice(F.filter("head", lambda x: x["pos"] != F.col("test_pos")), 1, k)
    example = lambda x, i: F.struct((i + 1).alias("rank"), x["pos"].alias("pos"), F.lit(None).cast("double").alias("similarity"), x["features"].alias("features"), x["grades"].alias("grades"))
    return records.select(F.col("pos").alias("test_pos"), own).crossJoin(F.broadcast(one)).select("test_pos", "features", F.transform(others, example).alias("examples"))


def blend(predictions: DataFrame, examples: DataFrame, records: DataFrame, weight: float) -> DataFrame:
    """(test_pos, dimension, predicted): predictions pulled toward the examples' grades, weighted by how alike they are.

    predictions is (test_pos, dimension, predicted). The weight is held between 0 and 0.5; examples weigh as much as their
    similarity exceeds the least one's, plus a millionth. Tests without examples keep their predictions.
    """
    weight = max(0.0, min(0.5, weight))
    w = Window.partitionBy("test_pos")
    dims = F.array(*map(F.lit, DIMENSIONS))
    prior = (
        examples.withColumn("share", F.col("similarity") - F.min("similarity").over(w) + 1e-6)
        .join(records.select("pos", "grades"), "pos")
        .select("test_pos", "share", F.explode(F.arrays_zip(dims.alias("d"), F.col("grades").alias("g"))).alias("z"))
        .groupBy("test_pos", F.col("z.d").alias("dimension"))
        .agg((F.sum(F.col("share") * F.coalesce("z.g", F.lit(0))) / F.sum("share")).alias("prior"))
    )
    p = F.coalesce(F.col("predicted"), F.lit(0)).cast("double")
    mixed = F.when(F.col("prior").isNull() | F.lit(weight <= 0), p).otherwise((1 - weight) * p + weight * F.col("prior"))
    return predictions.join(prior, ["test_pos", "dimension"], "left").select(
        "test_pos", "dimension", F.greatest(F.lit(0), F.least(F.lit(5), F.rint(mixed).cast("int"))).alias("predicted")
    )


def balanced_examples(records: DataFrame, k: int = 15) -> DataFrame:
    """The k records that greedily cover the most (dimension, grade) pairs, in order of pos.

    A set is worth the pairs that it covers and 100 more for every dimension with exactly five different grades. Each round is one
    aggregation over the records; the driver holds the covered pairs, a few for each dimension.
    """
    if records.limit(k + 1).count() <= k:
        return records.orderBy("pos")
    graded = cut(records.select("pos", "grades"))  # read k times
    covered: list[set[int]] = [set() for _ in DIMENSIONS]
    chosen: list[int] = []
    for _ in range(k):
        worth = F.lit(0)
        for i, have in enumerate(covered):
            g = F.get("grades", F.lit(i))
            new = g.isNotNull() & ~g.isin(*have) if have else g.isNotNull()
            size = F.lit(len(have)) + F.when(new, 1).otherwise(0)
            worth = worth + size + F.when(size == 5, 100).otherwise(0)
        best = graded.filter(~F.col("pos").isin(*chosen)) if chosen else graded
        row = best.agg(F.max_by(F.struct("pos", "grades"), F.struct(worth.alias("w"), -F.col("pos"))).alias("r")).first().r
        chosen.append(row.pos)
        for have, g in zip(covered, row.grades or [], strict=False):
            if g is not None:
                have.add(g)
    return records.filter(F.col("pos").isin(*chosen)).orderBy("pos")


def contrastive_examples(records: DataFrame, dimension: str, n: int = 6, seed: int = 42) -> DataFrame:
    """Low and high scorers of one dimension, by id: half from each side of the median of the different scores.

    Within a side, the md5 of "seed:id" decides. With one score only, both sides are the same records, which may then occur twice.
    """
    scored = records.withColumn("g", F.get("grades", F.lit(DIMENSIONS.index(dimension)))).filter("g is not null")
    different = [r[0] for r in scored.select("g").distinct().orderBy("g").collect()]  # as many as there are grades
    if not different:
        return scored.drop("g")
    middle = len(different) // 2
    high = different[middle + 1 :] or different[-1:]
    draw = lambda part, m: scored.filter(F.col("g").isin(*part)).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id", "pos").limit(m)
    n_low = -(-n // 2)
    return draw(different[: middle + 1], n_low).union(draw(high, n - n_low)).drop("g").orderBy("id")


