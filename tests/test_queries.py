"""Every registered query of the package against its SQL on a small folder of the given tables."""

import os


import duckdb
import pytest

from textquarry import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("customer", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.map(lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v.tolist() if hasattr(v, "tolist") else v)) if len(frame) else frame
    return sorted(map(tuple, plain.values.tolist()))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, tables, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLE_SQL:
        want = tables.sql(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_names():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)
