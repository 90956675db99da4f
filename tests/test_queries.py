"""Every query that has SQL, against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from ligature.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(v):
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    rows = sorted(tuple(map(text, r)) for r in out.collect())
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(out.columns)
    at = [want.columns.index(c) for c in out.columns]
    assert rows == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_plans_have_no_products(spark):
    for name in ("d2_within_cutoff", "d3_restrict_to_targets", "d5_lookup_affinity", "e15_pocket_sequence", "f11_prefix_state"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
