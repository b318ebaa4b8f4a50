"""The queries that SQL can express, against it, on the small tables and on odd ones."""

import duckdb
import pandas as pd
import pytest

from tessella.llm import chat, exact_dedup, license, queries

SF = "/root/testdata/sf0.01"
CONV = [(c, t, s, f"{s} {t}") for c in (1, None) for t in range(200) for s in ("amy", "bob", "cid")] + [(2, None, "a\r\nb", f"{i:04}") for i in range(1100)] + [(3, 1, " ", "<|x"), (3, 2, "system", None)]


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    rows = lambda d: sorted(([None if v is None or v is pd.NA or v != v else v for v in r] for r in d[sorted(d.columns)].itertuples(index=False)), key=repr)
    assert rows(got.astype(object)) == rows(want.astype(object))


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df())


def test_odd_conversations_equal_sql(spark):
    frame = pd.DataFrame(CONV, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    same(chat.rotate(spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string").repartition(5)).toPandas(), con.sql(queries.OP10_SQL).df())


ROWS = [(1, "same  text"), (1, "same text"), (1, "same\ttext"), (None, "same text"), (2, "Under the MIT License, cc-by-nc"), (None, "one two three four"), (None, "CC BY NC now"), (None, "CC BY NC now"),
        (3, None), (4, ""), (5, "apache license version 2 " * 400), (None, "x y"), (None, license.TEMPLATES["bsd"].replace("binary forms", "binary and other forms").upper())]


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op9_license_scan"])
def test_odd_documents_equal_sql(spark, name, monkeypatch):
    """Null and repeated ids, repeated rows; copies counted out in small portions."""
    monkeypatch.setattr(exact_dedup, "TIES", 2)
    rows = ROWS + [(9, "again and again")] * 7 + [(None, "nobody")] * 5
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", frame)
    same({"op2_exact_dedup": exact_dedup.dedup, "op9_license_scan": license.scan}[name](docs).toPandas(), con.sql(queries.oracle_sql()[name]).df())
