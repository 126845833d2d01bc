"""Every query of the store against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from remembra.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(table, names):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.collect(), df.columns)
    if name not in ORACLE:
        assert got
        return
    want = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["beliefs_superseded", "contradiction_upsert", "contradictions_of_memory"])
def test_pairs_are_scored_once(spark, name):
    assert not any(f.endswith("conversations.parquet") for f in QUERIES[name](spark, DATA).inputFiles())
