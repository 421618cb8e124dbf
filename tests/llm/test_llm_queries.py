"""Queries of the subpackage against their SQL, on the smallest tables."""

import duckdb
import pytest

from codeloom.llm.queries import CHECKS, QUERIES
from oracle import _rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, result.fetchall())


def test_entry_has_all():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(entry.oracle_sql()) <= set(names)
