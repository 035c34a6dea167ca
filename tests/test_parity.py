"""Every registered query with SQL gives the rows of its SQL."""

import pytest

from shelfrank.plans import catalog, retrieval


#: Earlier names of the same query are not run again.
NAMES = [n for n in [*retrieval.ORACLE_SQL, *catalog.ORACLE_SQL] if not n.endswith("_whole") and n not in retrieval.LATER]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(name, same_as_sql):
    same_as_sql(name)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
