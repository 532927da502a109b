"""Every query of the financial operators against its SQL."""

from __future__ import annotations

import pytest

from tallyspark import queries, run_queries

from .test_helpers import same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def one_run():
    """Queries over a whole run share one here, as each would make the same."""
    make, made = run_queries.whole_run, {}
    run_queries.whole_run = lambda spark, sf_dir: made.setdefault(sf_dir, None) or made.__setitem__(sf_dir, make(spark, sf_dir)) or made[sf_dir]
    yield
    run_queries.whole_run = make


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_like_its_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
