"""Every registered query runs on the smallest tables; every oracle key has a
query; entry() returns the flagship inventory."""

import pytest

import __spark_entry__ as E

QUERIES = E.queries()


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(QUERIES)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["issue_id", "issue_type", "column", "allowed_treatments",
                          "requires_explicit_human_decision"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    assert all(len(r) == len(df.columns) for r in rows)
