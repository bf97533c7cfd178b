"""Every query of the engine itself, against its SQL twin or, without one, for rows and a stable schema."""

import pytest

from rinsework import queries as Q
from tests.twin import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_twin(spark, name):
    same_rows(spark, SF, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_rows(spark, name):
    a, b = (Q.queries()[name](spark, SF) for _ in range(2))
    assert a.schema == b.schema
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) != []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
