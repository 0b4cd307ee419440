"""Every registered query of the engine against its SQL, over whole tables at the smallest scale."""

import pytest
from helpers import duck, duck_rows, spark_rows

from orrery.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    cols, rows = spark_rows(catalog.queries()[name](spark, SF))
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert cols
        return
    want_cols, want = duck_rows(con, sql)
    assert cols == want_cols
    assert rows == want


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
