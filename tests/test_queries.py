"""Every query that SQL can express, held against DuckDB; the others run."""

import pytest
from compare import same

from linkspan.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    same(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert FLAGSHIP in e.queries()
    assert e.entry(spark).count() > 0
