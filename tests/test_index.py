"""The cells of similar records: bounds, and the same rows as comparing all with all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import index, retrieve, similar
from tallyloom.plans.dims import DIMENSIONS, FLAG_FEATURES, NUMERIC_FEATURES

SCHEMA = "pos long, id long, " + ", ".join(f"{c} long" for c in NUMERIC_FEATURES) + ", " + ", ".join(f"{c} boolean" for c in FLAG_FEATURES) + ", grades array<int>"


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    draw = random.Random(8)
    kinds = [[draw.random() < 0.5 for _ in FLAG_FEATURES] for _ in range(12)]
    rows = []
    for i in range(400):
        flags = list(draw.choice(kinds))
        if draw.random() < 0.1:
            flags[draw.randrange(len(flags))] = None
        numbers = [draw.choice([0, 1, 2, 3, draw.randint(0, 60)]), draw.choice([0, draw.randint(0, 900)]), draw.randint(0, 4), draw.choice([None, 0, 1, -2])]
        rows.append((i, 1000 - i, *numbers, *flags, [draw.randint(0, 5) for _ in DIMENSIONS]))
    rows += [(400 + k, k, *rows[3][2:]) for k in range(60)]  # copies
    path = f"file://{tmp_path_factory.mktemp('records')}/r"
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def told(df):
    return sorted((r.test_pos, r["rank"], r.pos, round(r.similarity, 9)) for r in df.collect())


@pytest.mark.parametrize(("k", "least", "cells"), [(1, None, 1 << 17), (8, None, 60), (3, 8, 1 << 17), (500, 4, 1 << 17), (2, 8, 1)])
def test_same_rows_as_all_pairs(spark, records, k, least, cells):
    tests = records.filter("pos % 23 = 0")
    want = told(similar.nearest(similar.candidates(records, tests, least), k))
    assert told(index.most_similar(records, tests, k, index=index.index_of(records, least, cells))) == want and want


def test_margin_and_fewer_comparisons(spark, records):
    tests = records.filter("pos % 23 = 0")
    whole = similar.candidates(records, tests)
    kth = similar.nearest(whole, 4).filter("rank = 4").select("test_pos", F.col("similarity").alias("kth"))
    want = {(r.test_pos, r.pos) for r in whole.join(kth, "test_pos").filter("similarity >= kth - 1.5").collect()}
    got = {(r.test_pos, r.pos) for r in index.near_pairs(records, tests, 4, index.index_of(records), margin=F.lit(1.5)).collect()}
    assert want <= got and len(got) < whole.count() / 2


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_mmr_by_kinds_of_grades_picks_the_same_from_fewer_pairs(spark, records, k, monkeypatch):
    six = records.withColumn("grades", F.array(*((F.col("pos") * 7 % 6 + i) % 6 for i in range(len(DIMENSIONS)))).cast("array<int>"))
    tests, pools, plain = six.filter("pos % 23 = 0"), [], retrieve.near_pairs
    monkeypatch.setattr(retrieve, "near_pairs", lambda *a, **b: pools.append(plain(*a, **b)) or pools[-1])
    got = told(retrieve.mmr_examples(six, tests, k))
    monkeypatch.setattr(retrieve, "MOST_KINDS", 0)
    assert got == told(retrieve.mmr_examples(six, tests, k)) and len(got) == k * tests.count()
    few, all_ = (p.count() for p in pools)
    assert few < all_


def test_tests_are_dealt_out_to_tasks_and_looked_at_few_at_a_time(spark, records, monkeypatch):
    tests = records.filter("pos % 23 = 0")
    want = told(index.most_similar(records, tests, 3))
    monkeypatch.setattr(index, "AT_ONCE", 1)
    monkeypatch.setattr(index, "IN_TASK", 500)
    pairs = index.most_similar(records, tests, 3)
    assert told(pairs) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_records_of_the_same_features_are_one_test_with_the_same_picks(spark, records, monkeypatch):
    six = records.withColumn("grades", F.array(*((F.col("pos") * 7 % 6 + i) % 6 for i in range(len(DIMENSIONS)))).cast("array<int>"))
    seen, plain = [], retrieve.near_pairs
    monkeypatch.setattr(retrieve, "near_pairs", lambda r, t, *a: seen.append(t.count()) or plain(r, t, *a))
    got = told(retrieve.mmr_held_out(six, 2))
    assert seen == [six.select(*FLAG_FEATURES, *NUMERIC_FEATURES).distinct().count()] and seen[0] < six.count()
    monkeypatch.undo()
    assert got == told(retrieve.mmr_examples(six, six, 2)) and len(got) == 2 * six.count()


def test_cells_of_unlike_flags_are_passed_over(spark, records, monkeypatch):
    tests = records.filter("pos % 23 = 0")
    want, looked, plain = told(index.most_similar(records, tests, 3)), [], index._bounds_from
    found = index.index_of(records)
    held = found.cells.value
    monkeypatch.setattr(index, "FIRST", 8)
    monkeypatch.setattr(index, "_bounds_from", lambda same, *a: looked.append(len(same)) or plain(same, *a))
    flags, cells = held["patterns"][held["pattern"][0]], np.arange(len(held["n"]))
    same = ((flags * np.repeat(index._weights()[0], 3)) @ held["patterns"].T)[held["pattern"]]
    index._wanted(same, held["low"][:1], np.zeros(1), held, cells, 1, False)
    assert max(looked) < len(cells)
    monkeypatch.setattr(index, "_bounds_from", plain)
    assert told(index.most_similar(records, tests, 3)) == want


def test_bounds_hold():
    draw = np.random.default_rng(1)
    n = len(NUMERIC_FEATURES)
    flags = lambda size: np.eye(3)[draw.integers(0, 3, (size, len(FLAG_FEATURES)))].reshape(size, -1)
    tests, cells = flags(30), flags(40)
    x, low = draw.integers(-3, 50, (30, n)).astype(float), draw.integers(-3, 50, (40, n)).astype(float)
    high = low + draw.integers(0, 20, (40, n))
    least, most = index.bounds(tests, x, cells, low, high)
    flag_weight, number_weight = index._weights()
    for _ in range(20):
        y = low + draw.random((40, n)) * (high - low)
        true = (tests * np.repeat(flag_weight, 3)) @ cells.T + sum(w * index._closeness(x[:, j, None], y[None, :, j]) for j, w in enumerate(number_weight))
        assert (least - 1e-9 <= true).all() and (true <= most + 1e-9).all()


def test_no_records_and_no_tests(spark, records):
    none = records.limit(0)
    assert index.most_similar(none, records, 3).count() == 0 and index.most_similar(records, none, 3).count() == 0
    one = records.filter("pos = 0")
    assert index.most_similar(one, one, 3).count() == 0 and retrieve.mmr_examples(one, one, 3).count() == 0
