"""Every query of the engine against DuckDB on the smallest tables."""

import pytest

from basalt import catalogue
from comparing import both, connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, con, name):
    got, want = both(spark, con, QUERIES[name], ORACLES[name], SF)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_shortest_paths_have_even_lengths(spark):
    rows = QUERIES["graph_shortest"](spark, SF).collect()
    assert all(r["hops"] % 2 == 0 for r in rows)
