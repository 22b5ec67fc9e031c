import pytest

import __spark_entry__ as entry
from foliant.plans.catalogue import ORACLES, QUERIES

from oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, data, name):
    got, want = compare(spark, data, QUERIES[name], ORACLES[name])
    assert got[0] == want[0]
    assert sum(got[1].values()) == sum(want[1].values())
    assert not (got[1] - want[1]), f"only here: {list((got[1] - want[1]))[:2]}\nonly in SQL: {list((want[1] - got[1]))[:2]}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
