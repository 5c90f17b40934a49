"""Every registered query of the library itself: collected and held against its SQL.

All are written as well, as pruning differs from plan to plan and a count shows nothing of it.
"""

import math

import duckdb
import pytest

import __spark_entry__
from tallyloom.plans import oracles, oracles_more
from tallyloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = oracles.ORACLES | oracles_more.ORACLES


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, tmp_path, name):
    df = __spark_entry__.queries()[name](spark, SF)
    collected = [tuple(map(plain, r)) for r in df.collect()]
    assert collected
    df.write.parquet(f"{tmp_path}/out")
    written = [tuple(map(plain, r)) for r in spark.read.parquet(f"{tmp_path}/out").select(*df.columns).collect()]
    assert len(written) == df.count() and sorted(map(str, collected)) == sorted(map(str, written))
    if name in ORACLES:
        found = tables.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        rows = [tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall()]
        assert sorted(map(str, collected)) == sorted(map(str, rows))
