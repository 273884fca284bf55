"""Queries over graphs whose keys run beyond the millions, as in large tables."""

import pytest

from basalt import catalogue
from comparing import both, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stride", [1_000_000, 10_000_000])
@pytest.mark.parametrize("name", ["graph_shortest", "graph_1hop", "graph_delete"])
def test_keys_of_any_size(spark, tmp_path, name, stride):
    con = connection(SF)
    for table in ("customer", "orders", "lineitem", "part"):
        columns = [c if "nation" in c or not c.endswith("key") else f"{c} + i * {stride} AS {c}" for c in con.table(table).columns]
        con.sql(f"COPY (SELECT {', '.join(columns)} FROM {table}, range(0, 30, 10) r(i)) TO '{tmp_path}/{table}.parquet'")
    got, want = both(spark, connection(tmp_path), catalogue.queries()[name], catalogue.oracle_sql()[name], str(tmp_path))
    assert got == want
