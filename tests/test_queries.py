"""Every query runs on the smallest tables; those with SQL give what DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("QUERN_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in got.collect()]
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert canonical(got.columns, rows) == canonical(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
