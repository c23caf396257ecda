"""Registered telemetry queries against their DuckDB SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from emberlane.plans import catalog
from emberlane.sources import scratch

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "customer documents events lineitem nation orders part region supplier".split()


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(DIR):
        pytest.skip(f"{DIR} isn't there")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return connection


def plain(value):
    value = float(value) if hasattr(value, "as_tuple") else value
    return round(value, 6) if isinstance(value, float) else value


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    """Rows are matched in order of rounded values, then compared closely: sums may end in other digits."""
    frame = catalog.QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    told = sql.execute(catalog.ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    rows = [[dict(zip(names, row))[c] for c in columns] for row in told.fetchall()]
    order = lambda row: [repr(plain(v)) for v in row]
    got = sorted(([r[c] for c in columns] for r in frame.collect()), key=order)
    want = sorted(rows, key=order)
    assert len(got) == len(want)
    number = lambda v: float(v) if hasattr(v, "as_tuple") else v
    assert [(g, w) for g, w in zip(got, want) if not all(same(number(a), number(b)) for a, b in zip(g, w))] == []
    scratch.cleared(spark)


def test_entry_points():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
