"""Driver contract: entry runs, every query has a name-matched oracle or is rows-only."""

import pytest

import __spark_entry__ as E
from synthscore.plans import all_queries

from .conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) == {"sampler", "average_rank", "n_datasets"}


def test_registry_names():
    q, s = E.queries(), E.oracle_sql()
    assert q and set(s) <= set(q)


# the training-data queries have their own tests
@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_runs_small(spark, name):
    df = all_queries()[name](spark, SF_SMALL)
    assert df.columns
    df.limit(1).collect()
