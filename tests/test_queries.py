"""Every registered query against its SQL on the smallest tables."""

import pytest

from gleaner import catalog
from tests.oracle import rows_of, sql_rows

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, name):
    cols, rows = rows_of(catalog.queries()[name](spark, small))
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows is not None
        return
    assert (cols, rows) == sql_rows(sql, small)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
