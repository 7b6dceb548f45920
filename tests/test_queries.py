"""Every core query runs on the smallest tables and agrees with its SQL twin."""

import pytest

from recallspark.plans import catalogue
from recallspark.plans.compare import difference


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.ORACLES:
        assert difference(df, duck, catalogue.ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
