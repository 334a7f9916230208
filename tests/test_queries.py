"""Every engine query against its SQL, or at least run where it has none."""

import pytest
from compare import SF_DIR, same

from tidewell.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        same(df, oracle.sql(ORACLES[name]))
    else:
        assert len(df.columns) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
