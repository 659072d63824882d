"""Every query with SQL agrees with DuckDB on the smallest tables; the others return rows."""

import math

import duckdb
import pytest

from plumbline.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
# A slow panel query without SQL: its parts are tested in test_operators.
SLOW = {"percentile_mode_panel"}
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return int(x) if hasattr(x, "item") and not isinstance(x, bool) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    rel = duck.execute(SQL[name])
    want_names = [d[0] for d in rel.description]
    assert sorted(got.columns) == sorted(want_names)
    assert {c: t for c, t in got.dtypes} == {d[0]: TYPES[str(d[1])] for d in rel.description}
    got_rows, want = rows(got.columns, got.collect()), rows(want_names, rel.fetchall())
    assert len(got_rows) == len(want)
    for g, w in zip(got_rows, want):
        for a, b in zip(g, w):
            assert a == pytest.approx(b, abs=2e-6) if isinstance(b, float) and isinstance(a, float) else a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
