import pytest

import __spark_entry__ as entry
from vetch.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, small, duck, same_rows, name):
    same_rows(Q.queries()[name](spark, small), duck, Q.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
