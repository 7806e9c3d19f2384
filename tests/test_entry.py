import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["extract_emails", "normalize_date", "normalize_phone_e164", "validate_emails", "cluster_components", "union_emails", "merge_experience", "field_confidence"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        columns, rows = want.columns, want.fetchall()
    got = entry.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in rows)
