"""Every query with SQL agrees with DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from lattica.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert len(cols) == len(set(cols)) and rows and len(set(rows)) == len(rows)  # none of these repeats a row
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert rows == want


def test_lines_are_gone_through_once_for_all_views(spark):
    from lattica.plans.fixtures import Tables

    t = Tables(spark, SF)
    rows = t.deps().unionByName(t.calls()).unionByName(t.links().drop("edge_type"))
    assert not any("lineitem" in path for path in rows.inputFiles()) and t.deps().count() > 0
