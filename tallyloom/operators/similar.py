"""How alike records are, and every test's candidates.

Records have pos (their order, from 0), id, the columns of project_features() and grades (array<int> in the order of DIMENSIONS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scoring import complexity_band
from tallyloom.plans.dims import FEATURES, FLAG_FEATURES, NUMERIC_FEATURES

SALTS = 16
# Fixed values: (flags, weight of each, numbers, weight of each).
PROFILES = [
    (FLAG_FEATURES, 2.0, NUMERIC_FEATURES, 1.0),
    (["uses_loops", "uses_conditionals", "uses_algorithms", "uses_nesting", "uses_math"], 1.8, ["block_count"], 1.0),
    (["uses_event_handling", "uses_messaging", "uses_ui_feedback"], 2.0, ["sprite_count"], 1.1),
    (["uses_variables", "uses_lists", "uses_math"], 1.7, ["variable_count", "list_count"], 1.0),
]


def similarity(a: str = "a.", b: str = "b.") -> Column:
    """Of two records' features; both missing is a match."""
    total = F.lit(0.0)
    for flags, flag_weight, numbers, number_weight in PROFILES:
        for c in flags:
            total = total + F.when(F.col(a + c).eqNullSafe(F.col(b + c)), flag_weight).otherwise(0.0)
        for c in numbers:
            x, y = (F.coalesce(F.col(p + c), F.lit(0)).cast("double") for p in (a, b))
            total = total + number_weight * (1 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)))
    return total


def allowed_bands(records: DataFrame, least: int | None) -> Column:
    """For a record's band, the bands that its candidates come from: its own, then near ones, then all, until `least` are found.

    Only three counts reach the driver. The record itself is not a candidate.
    """
    return bands_for({} if least is None else {r[0]: r[1] for r in records.groupBy(complexity_band().alias("band")).count().collect()}, least)


def bands_for(n: dict[int, int], least: int | None) -> Column:
    """allowed_bands() from the records' counts by band."""
    if least is None:
        return F.array(F.lit(0), F.lit(1), F.lit(2))
    total = sum(n.values())
    out = None
    for band in range(3):
        near = [b for b in range(3) if abs(b - band) <= 1]
        wanted = min(total - 1, least)
        scope = next((s for s in ([band], near) if sum(n.get(b, 0) for b in s) - 1 >= wanted), [0, 1, 2])
        value = F.array(*map(F.lit, scope))
        out = F.when(F.col("band") == band, value) if out is None else out.when(F.col("band") == band, value)
    return out


def candidates(records: DataFrame, tests: DataFrame, least: int | None = None, salts: int = SALTS, bands: Column | None = None) -> DataFrame:
    """(test_pos, test_id, pos, id, similarity) of every test and its candidates.

    least: how many candidates a test should have before its complexity band is widened; None takes all records. bands: allowed_bands(), if it
    is known. Candidates are
    dealt out by band and salt, tests are repeated for each salt, so that three bands don't mean three tasks.
    """
    features = lambda a: [F.struct(*(F.col(c) for c in FEATURES)).alias(a)]
    band = complexity_band().alias("band")
    salt = F.pmod(F.xxhash64("pos"), F.lit(salts)).cast("int").alias("salt")
    right = records.select("pos", "id", salt, band, *features("b"))
    left = (
        tests.select(F.col("pos").alias("test_pos"), F.col("id").alias("test_id"), band, *features("a"))
        .withColumn("band", F.explode(allowed_bands(records, least) if bands is None else bands))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    return left.join(right, ["band", "salt"]).filter("pos <> test_pos").select("test_pos", "test_id", "pos", "id", similarity().alias("similarity"))


def nearest(pairs: DataFrame, k: int = 8) -> DataFrame:
    """pairs with rank (from 1), the k most similar candidates of each test; ties go by pos."""
    w = Window.partitionBy("test_pos").orderBy(F.col("similarity").desc(), "pos")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
