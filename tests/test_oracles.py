"""Every registered query against its SQL oracle on the small tables."""
import math
from pathlib import Path

import duckdb
import pytest

from scrubwell.checks import catalog, fixtures

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in fixtures.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return None if value is None else str(value)


@pytest.mark.parametrize("name", [n for n, (_, oracle) in catalog.CHECKS.items() if oracle])
def test_query_equals_oracle(spark, sql, name):
    query, oracle = catalog.CHECKS[name]
    df = query(spark, str(FOLDER))
    expected = sql.sql(oracle)
    assert sorted(df.columns) == sorted(expected.columns)
    order = sorted(df.columns)
    at = [expected.columns.index(c) for c in order]
    got = sorted(str([canonical(row[c]) for c in order]) for row in df.collect())
    want = sorted(str([canonical(row[i]) for i in at]) for row in expected.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n, (_, oracle) in catalog.CHECKS.items() if not oracle])
def test_query_without_oracle_returns_rows(spark, name):
    assert catalog.CHECKS[name][0](spark, str(FOLDER)).count() > 0


@pytest.mark.parametrize("name", ["MC", "MC_DUP", "MO", "ML", "MT", "SK"])
def test_fixture_is_the_same_in_both_engines(spark, sql, name):
    text = getattr(fixtures, name)
    got = sorted(str([canonical(v) for v in r]) for r in fixtures.from_sql(spark, str(FOLDER), text).collect())
    assert got == sorted(str([canonical(v) for v in r]) for r in sql.sql(fixtures.oracle(text)).fetchall())
