"""Every registered query runs, and gives the rows of its SQL."""

import json
import math
import os
from collections import Counter

import pytest

from hopmine import registry


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return int(value) if isinstance(value, bool) else value


def rows(found):
    return Counter(json.dumps([plain(v) for v in r], default=str) for r in found)


@pytest.fixture(scope="module")
def con(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
    else:
        found = con.sql(sql)
        assert sorted(found.columns) == columns
        assert rows(got) == rows(found.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
