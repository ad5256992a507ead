"""Every registered query of the rule operators at the smallest scale: against its SQL, or that it has rows."""

import pytest

from ruleloom import queries
from tests.oracle import agree

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"projected_pairs", "discovery_two_tables"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLE_SQL:
        agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    else:
        got = queries.QUERIES[name](spark, SF)
        assert got.columns
        assert got.count() >= (0 if name in MAY_BE_EMPTY else 1)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
