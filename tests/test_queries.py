"""Every registered query against its SQL counterpart, whole tables, smallest scale."""

import pytest

from codeloom.plans import CHECKS, QUERIES
from oracle import SF, compare

ROWS_ONLY = sorted(set(QUERIES) - set(CHECKS))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, SF, name) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
