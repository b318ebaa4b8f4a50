"""Queries on tables larger than the smallest read all of their rows."""

import duckdb
import pytest
from test_queries import rows

from tessella.plans import catalog

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["C18", "C19", "C20", "C21", "U03"])
def test_all_embeddings_are_clustered(spark, name):
    """The 2000 rows of this table."""
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert con.sql("select count(*), max(vec_id) from embeddings").fetchall() == [(2000, 1999)]
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert rows(got) == rows(want)
    if name in ("C18", "C20"):
        assert len(got) == 2000
