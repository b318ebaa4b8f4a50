"""Feature clustering where ids don't fill the lattice, or occur more than once."""

import duckdb
import pytest
from test_queries import rows

from tessella.plans import catalog

SOURCE = "/root/testdata/sf0.1/embeddings.parquet"
TABLES = {
    "last row short": f"select * from '{SOURCE}' where vec_id < 256",
    "gaps": f"select * from '{SOURCE}' where vec_id < 407 and vec_id % 7 <> 3 and vec_id not between 100 and 160",
    "repeated": f"select vec_id % 207 as vec_id, embedding, label from '{SOURCE}' where vec_id < 600",
}


@pytest.mark.parametrize("kind", TABLES)
@pytest.mark.parametrize("name", ["C18", "C19", "C20", "C21", "U03"])
def test_density_holds_between_pixels(spark, tmp_path, name, kind):
    con = duckdb.connect()
    con.sql(f"copy ({TABLES[kind]}) to '{tmp_path}/embeddings.parquet' (format parquet)")
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert rows(got) == rows(want)
