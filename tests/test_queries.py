"""Registered queries against DuckDB on the smallest tables: a selection, or all with TESSELLA_ALL=1."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella.plans import catalog

SOME = ["V02", "V11", "K02", "K05", "K08", "SRC02", "T12", "R03", "R06", "F04", "F07", "P04", "P17", "C03", "C05", "C19", "N06", "G02", "G08", "E01", "E11", "SNK07", "ST04", "U01"]
NAMES = sorted(catalog.ORACLES) if os.environ.get("TESSELLA_ALL") else SOME
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        return float(x) if isinstance(x, (int, float, np.number, bool, np.bool_)) else str(x)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_text_operators():
    """The library's own queries don't need the text subpackage."""
    import pathlib

    root = pathlib.Path(catalog.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tessella.llm" not in path.read_text(), path
