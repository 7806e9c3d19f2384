import os

import duckdb
import pytest

import __spark_entry__ as entry
from braidwork import catalogue_audit

DATA = "/root/testdata/sf0.001"
#: Queries that run the whole engine take over ten seconds each; one of them stands for the others here.
SLOW = {"conflict_rows", "field_decisions", "confidence_details", "version_history", "inferred_location", "project_nested"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(catalogue_audit.oracle_sql()) - SLOW))
def test_against_sql(spark, name):
    with duckdb.connect() as con:
        for t in ("customer", "orders", "part", "supplier"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        columns, rows = want.columns, want.fetchall()
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in rows)
